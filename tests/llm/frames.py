"""Small tables that hold every awkward case: nulls, empty and very long texts, ties, repeated rows,
clashing names."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS int, quality string"
PAGES = "page_id long, url string, html string, VERDICT string, node int"

WORDS = [a + b + c for a in ("th", "er", "on", "an") for b in ("e", "in", "ou", "ti") for c in ("st", "nd", "re", "ble", "")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    lines, left = [], n
    while left > 0:
        k = min(left, rng.randint(5, 30))
        lines.append(" ".join(rng.choices(WORDS, k=k)) + ".")
        left -= k
    return "\n".join(lines)


def changed(text: str, seed: int, times: int) -> str:
    """`text` with some words replaced."""
    rng = random.Random(seed)
    words = text.split(" ")
    for at in rng.sample(range(len(words)), times):
        words[at] = f"new{seed}x{at}"
    return " ".join(words)


def texts() -> list[tuple[int | None, str | None]]:
    base, other = prose(1, 200), prose(2, 300)
    rows = [
        (1, base), (2, base), (3, changed(base, 3, 3)), (4, changed(base, 4, 5)), (5, other), (6, changed(other, 6, 4)),
        (7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "one two three four"), (12, "one two three four"),
        (13, prose(13, 5000)), (14, "word " * 30000), (15, "x" * 50000), (16, prose(16, 40) + "\n" + other[:900]),
        (None, "a text without an id but with some words in it"), (None, None), (17, base), (17, base), (17, "same id, other text"),
        (18, "é ç ñ ß 日本語 🙂🙂     \x85 \x1c done"), (19, "<|endoftext|> a <|endoftext|>"), (-5, prose(20, 60)),
        (20, "# | % " * 40), (21, "Line one here.\nLine one here.\n\nLine one here."), (22, "\r\n  two   blanks \r\n\r\n end  "),
    ]
    return rows


def documents(spark):
    """All cases, with extra columns whose names clash with those of the operators."""
    sources = ["b", "a", None, "b", "Ä", "", "b"]
    rows = [(i, t, None if k % 5 == 0 else "en", sources[k % 7], None if t is None else len(t), k, "q") for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def pages(spark):
    article = "<html><head><title>t</title></head><body><nav><a href='/'>home</a></nav><article><h1>Head &amp; line</h1><p>Some\n text <b>bold</b>.</p></article><footer>foot</footer></body></html>"
    canonical = "<html><head><link rel='canonical' href='{}'></head><body><main><p>x</p></main></body></html>"
    rows = [
        (1, "http://a.example.org/es/1", article), (2, "http://a.example.net/copy", canonical.format("http://a.example.org/es/1")),
        (3, "http://b.example.net/x", canonical.format("http://a.example.net/copy")), (4, None, article), (5, "no scheme", None),
        (6, "HTTP://WWW.Example.COM/fr/1?q=1#f", ""), (7, "http://m.example.com/de/9", canonical.format("/fr/9")),
        (8, "http://m.example.com/fr/9", article), (8, "http://m.example.com/fr/9", article), (9, "http://q.example.net/z", canonical.format("http://m.example.com/de/9")),
        (None, "http://example.net", "<p>" + "long text " * 5000), (10, "http://example.org/en/12", "<script>never closed"), (11, "https://e.org?x", "<p>a<p>b"),
        (12, "http://b.example.net/x#part", "<meta http-equiv=refresh content='0; url=http://c.example.net/y'>"), (13, "http://c.example.net/y/", article),
    ]
    return spark.createDataFrame([(*r, "v", 1) for r in rows], PAGES).repartition(3)


def no_pages(spark):
    return spark.createDataFrame([], PAGES)
