from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 0, n: int = 120) -> list[str | None]:
    """Prose, copies, near copies, repeats, odd white space, long and empty texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = prose(60)
    out: list[str | None] = [None, "", " ", "\n", "a", "a\n\na\na", "A.B,c", "x" * 5000, "word " * 400, "\n".join(["same line"] * 9) + "\n", "é" * 90, "\x0b\x0c\r\t tab nbsp ", "#$% |<>&* ###", "\U0001f600 smile　wide"]
    while len(out) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(out) > 20:
            out.append(rng.choice([t for t in out if t and len(t) > 20]))
        elif kind == 1:
            base = prose(rng.randint(60, 200)).split()
            out.append(" ".join(base))
            base[rng.randrange(len(base))] = "edited"
            out.append(" ".join(base))
        elif kind == 2:
            out.append(prose(30) + ". " + passage + "\n" + prose(40))
        elif kind == 3:
            out.append(prose(rng.randint(1, 2000)))
        else:
            out.append(prose(rng.randint(5, 80)).capitalize() + ".\n" + prose(20))
    return out[:n]


def documents(spark, rows):
    """rows: texts, or (doc_id, text) pairs."""
    rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
    return spark.createDataFrame([(i, t, None if i is None or i % 7 == 0 else "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
