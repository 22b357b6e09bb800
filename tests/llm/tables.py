"""Small tables with the odd cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_SYLLABLES = {"en": ("the", "er", "on", "tion", "ing", "and"), "de": ("der", "ung", "sch", "ein", "keit", "ü"), "fr": ("que", "le", "eau", "é", "ment", "ou")}


def prose(r: random.Random, lang: str, n: int) -> str:
    words = ["".join(r.choice(_SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + r.choice((" ", " ", " ", ", ", ".\n")) for w in words)


def documents(seed: int = 3, n: int = 60) -> list[tuple]:
    """Prose in three languages, copies, near copies, shared passages, nulls, empty, blank, one-word and long texts, a repeated row."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(_SYLLABLES))
        out.append((i, prose(r, lang, r.randint(3, 120)), lang, f"s{i % 3}"))
    passage = prose(r, "en", 30)
    for k in range(8):
        words = out[k][1].split(" ")
        words[len(words) // 2] = "edited"
        out.append((n + k, out[k][1], out[k][2], "s0"))
        out.append((n + 10 + k, " ".join(words), out[k][2], "s0"))
        out.append((n + 20 + k, prose(r, "en", 20) + passage + prose(r, "en", 5), "en", "s0"))
    out += [
        (900, None, "en", "s1"), (901, "", "de", "s1"), (902, " \n\t ", "fr", None), (903, "the", None, "s9"), (904, "the", "en", "s9"),
        (905, prose(r, "en", 9000), "en", "s2"), (906, "a" * 40_000, "en", "s2"), (907, "same line\n" * 40, "en", "s2"),
        (908, "mark### up%%% all&&& " * 30, "en", "s0"), (909, "12 34 <|endoftext|> 日本語 🙂 don't　x y", None, None),
        (910, "The THE the tHe", "en", "s1"), (910, "The THE the tHe", "en", "s1"), (None, "no id here at all", "en", "s1"), (911, None, None, None),
    ]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
