"""Documents with every odd case, and helpers of the brute-force versions."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, hits int, k0 int, component_id string"
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def alnum(text: str | None) -> list[bytes]:
    return ALNUM.findall(lower(text))


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lower(text))


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    out = [f"w{rng.randrange(vocabulary)}é"[: rng.randrange(3, 7)] + chr(97 + rng.randrange(26)) for _ in range(n)]
    return " ".join(x + ("\n" if rng.random() < 0.1 else "") for x in out)


def documents(spark, more: list[tuple[int | None, str | None]] = (), seed: int = 1, n: int = 30):
    """Prose, copies, near copies, repeated rows, nulls in every column, empty, blank and very long texts."""
    rng = random.Random(seed)
    texts: list[tuple[int | None, str | None]] = []
    for k in range(n):
        texts.append((k, prose(rng, rng.randrange(1, 160))))
    base, twice = prose(rng, 120), prose(rng, 90)
    texts += [(100 + k, base) for k in range(6)]
    for k in range(12):
        changed = base.split(" ")
        for _ in range(k):
            changed[rng.randrange(len(changed))] = f"x{rng.randrange(1000)}"
        texts.append((200 + k, " ".join(changed)))
    texts += [(300, None), (301, ""), (302, " \n\t "), (303, "one"), (304, "One"), (305, prose(rng, 9000)), (306, "one two"),
              (307, twice), (307, twice), (None, texts[1][1]), (None, None), (308, "é" * 3000), (309, "42 -- !!")]
    texts += list(more)
    rows = [(i, t, None if k % 5 == 0 else ("en", "fr")[k % 2], None if k % 7 == 0 else f"s{k % 3}", None, "clash", 7, 8, "clash") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
