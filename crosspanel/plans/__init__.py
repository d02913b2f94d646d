"""Factor formulas and how they are evaluated."""
