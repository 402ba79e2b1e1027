"""Quality rules, lines, HTML and tokens against plain Python."""

from __future__ import annotations

import json
import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from playlens.llm import bpe, html, lines, packing, quality, tokens
from playlens.llm.common import tokenizer_path
from tests.llm import frames

TEXT = st.text(st.sampled_from("ab .\n\t'1é日\x85\x1c <|endoftext|>"), max_size=60)


def plain_measures(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    covered = set()
    for i in range(len(words) - 4):
        if sum(words[j:j + 5] == words[i:i + 5] for j in range(len(words) - 4)) > 1:
            covered |= set(range(i, i + 5))
    full = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    duplicates = sum(line in full[:i] for i, line in enumerate(full))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    return len(words), sum(map(len, words)), symbols, len(full), duplicates, len(covered), stutters


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_measures(text):
    assert quality.measure(text) == plain_measures(text)


def test_measures_of_prose():
    for text in ["a b c d e f " * 9, "x y " * 20 + frames.prose(5, 80) + " x y x y x", frames.prose(6, 90) * 2]:
        assert quality.measure(text) == plain_measures(text)


def test_ledger_and_ablation(spark):
    docs = frames.documents(spark)
    rows, name = quality.ledger(docs)
    got = {(r["doc_id"], r["text"]): r[name] for r in rows.collect()}
    failed = {k: v["failed"] for k, v in got.items()}
    assert failed[(7, None)] & 1 and failed[(20, "# | % " * 40)] & 4 and failed[(1, frames.prose(1, 200))] == 0
    report = quality.ablation(rows.select(f"{name}.failed")).collect()
    every = [r[name]["failed"] for r in rows.collect()]
    for row in report:
        policy = {p.name: p for p in (quality.BASE, quality.CORPUS)}[row["policy"]]
        bit = {r.name: r.mask for r in quality.RULES}[row["rule"]]
        assert row["documents"] == len(every)
        assert row["failing"] == sum(bool(f & bit) for f in every)
        assert row["sole"] == sum(f & policy.mask == bit for f in every)
        assert row["rejected"] == sum(bool(f & policy.mask) for f in every)
    bits = [rule.bit for rule in quality.RULES]
    assert len(set(bits)) == len(bits)


def library(texts: list[str]) -> list[list[int]]:
    """Ids as the library gives them."""
    found = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found]


def test_ids_of_awkward_texts():
    encoder = packing.ids(tokenizer_path())
    assert encoder.fast is not None
    texts = [t or "" for _, t in frames.texts()] + [
        " " * 5000 + "x", "a\n" * 900 + "\n" * 700, "\t \n" * 400, "x<|endoftext|>", "<|endoftext|>\n\n <|endoftext|> y", "a" * 3000,
        "ab" * 2000, "é\u0301 Ⅷ ½ 数 १२ \U0001F642\u200d", "\x00\x1c\x85\u2028",
    ]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.of(texts)] == library(texts)


def test_ids_of_all_characters():
    """Both libraries cut at the same classes of characters."""
    encoder = packing.ids(tokenizer_path())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b {chr(c)}1{chr(c)} .{chr(c)}" for c in points[at:at + 500]) for at in range(0, len(points), 500)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.of(texts)] == library(texts)


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    spec = json.loads(Path(tokenizer_path()).read_text())
    spec["model"]["merges"] = spec["model"]["merges"][:300]  # most tokens can't be merged any more
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    encoder = packing.Ids(str(path))
    expected = Tokenizer.from_file(str(path)).encode("the other one", add_special_tokens=False).ids
    assert encoder.fast is None and np.frombuffer(encoder.of(["the other one"])[0], "<u4").tolist() == expected


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces_give_the_text_and_its_tokens(text):
    keys = bpe.pieces(text)
    assert "".join(map(bpe.piece, keys)) == text
    expected = library([text])[0]
    assert packing.ids(tokenizer_path()).of([text]) == [np.array(expected, "<u4").tobytes()]
    assert tokens.counter(tokenizer_path()).count([text]) == [len(expected)]


def test_token_counts_of_awkward_texts():
    texts = [t or "" for _, t in frames.texts()] + ["a" * 999, "ab" * 500, "aaab" * 100 + " baaa", "Ġ Ġ Ġa"]
    expected = [len(x) for x in library(texts)]
    assert tokens.Counter(tokenizer_path()).count(texts) == expected
    small = tokens.Counter(tokenizer_path())
    small.known.limit = 3  # forgets all the time
    assert small.count(texts) == expected


def test_memory_is_bounded():
    memory = bpe.Recent(lambda keys: [len(k) for k in keys], 10)
    for i in range(50):
        memory.learn([[str(i), str(i + 1)]])
        assert memory[str(i)] == len(str(i)) and len(memory) <= 10


# Lines

def brute_windows(words: list[int], guarantee: int) -> set[tuple[int, int]]:
    """All windows with enough words that no window at the same end, or at the same start, is shorter than."""
    n = len(words)
    enough = {(a, b) for a in range(n) for b in range(a + 1, n + 1) if sum(words[a:b]) >= guarantee}
    return {(a, b) for a, b in enough if (a + 1, b) not in enough or (a, b - 1) not in enough}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5)), max_size=25), st.integers(1, 40))
def test_winnow(rows, guarantee):
    words, hashes = [n for n, _ in rows], [h for _, h in rows]
    places = lines.windows(words, guarantee)
    assert set(places) == brute_windows(words, guarantee)
    order = [(-n.bit_length(), h) for n, h in rows]
    expected = [max(i for i in range(a, b) if order[i] == min(order[a:b])) for a, b in places]
    assert lines.winnow(hashes, words, places) == expected


def test_equal_runs_have_equal_fingerprints():
    """Wherever a run of enough words stands, it has a selected line and a window in common with itself."""
    run = "\n".join(frames.prose(60 + i, 9).replace("\n", " ") for i in range(4))
    sets = []
    for before, behind in (("", ""), ("one\ntwo\n", "\nthree"), (frames.prose(61, 50) + "\n", "\n\n" + frames.prose(62, 50))):
        _, found = lines.fingerprints(before + run + behind)
        sets.append({packed[i:i + 16] for packed in found.values() for i in range(0, len(packed), lines.PACKED)})
    assert sets[0] and sets[0] <= sets[1] and sets[0] <= sets[2]
    blob, found = lines.fingerprints(frames.prose(63, 3000))
    assert len(found) < 0.7 * len(blob) // lines.LINE, "fewer fingerprints than lines"


def blob(text: str) -> bytes:
    return b"".join(lines.line_hash(x).to_bytes(16, "little") for x in text)


def test_matches_are_verified_and_extended():
    assert lines.extended(blob("xabcdy"), blob("abcd"), [(2, 3, 1)]) == [(1, 5)], "both ways"
    assert lines.extended(blob("xabcdy"), blob("zbcw"), [(2, 4, 1)]) == [(2, 4)]
    assert lines.extended(blob("xabcdy"), blob("zbcw"), [(1, 3, 1)]) == [], "a key that collided deletes nothing"
    assert lines.extended(blob("aaaaa"), blob("aaaaa"), [(i, i + 1, 0) for i in range(1, 5)]) == [(1, 5)]
    assert lines.extended(blob("abcabd"), blob("abc"), [(3, 5, 0), (0, 2, 0)]) == [(0, 5)]


def test_repeated_passages_go_and_the_first_stays(spark):
    passage = "\n".join(frames.prose(90 + i, 14).replace("\n", " ") for i in range(5))
    short = "just a few words that every page has"
    texts = {i: "\n".join([frames.prose(100 + i, 30), short, passage if i % 2 else frames.prose(200 + i, 20), short, f"tail {i}"]) for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in lines.digest(docs).collect()}
    for i, text in texts.items():
        if i % 2 and i > 1:
            assert passage not in got[i]["text"] and got[i]["n_deleted"] >= 5
            assert got[i]["text"].startswith(frames.prose(100 + i, 30))
        else:
            assert got[i]["text"] == text and got[i]["n_deleted"] == 0


def test_runs_against_brute_force(spark):
    rng = random.Random(3)
    pool = [frames.prose(300 + i, rng.choice([3, 8, 12, 25])).replace("\n", " ") for i in range(40)]
    texts = {}
    for i in range(40):
        rows = [rng.choice(pool) if rng.random() < 0.3 else f"own {i} {k} " + frames.prose(i * 100 + k, 6) for k in range(8)]
        at = rng.randrange(30)
        texts[i] = "\n".join(rows + pool[at:at + 4])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.digest(docs).collect()}
    for i, gone in repeated_lines(texts).items():
        assert got[i] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
    kept = {line for text in got.values() for line in text.split("\n")}
    assert kept >= {line for text in texts.values() for line in text.split("\n")}, "no line vanishes altogether"


def repeated_lines(texts: dict) -> dict[int, set]:
    """The lines of each text that are in a run of enough words which starts at an earlier position, whatever comes between."""
    rows = {i: [x.strip() for x in t.split("\n")] for i, t in texts.items()}
    starts, gone = [(i, at) for i in sorted(rows) for at in range(len(rows[i]))], {i: set() for i in rows}
    for n, (i, at) in enumerate(starts):
        for source, there in starts[:n]:
            size = 0
            while at + size < len(rows[i]) and there + size < len(rows[source]) and rows[i][at + size] == rows[source][there + size]:
                size += 1
            if sum(len(x.split()) for x in rows[i][at:at + size]) >= lines.GUARANTEE:
                gone[i] |= set(range(at, at + size))
    return gone


def test_runs_whose_lines_came_earlier_alone(spark):
    """A repeated run has its source even if each of its lines was seen before, elsewhere and alone."""
    run = [frames.prose(700 + i, 15).replace("\n", " ") for i in range(4)]
    texts = {i: f"own {i} words\n{line}\nother {i} words" for i, line in enumerate(run)} | {10: "\n".join(run), 11: "\n".join(["before", *run, "behind"])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.digest(docs).collect()}
    assert got == texts | {11: "before\nbehind"}


def test_runs_against_all_earlier_positions(spark):
    rng = random.Random(4)
    pool = [frames.prose(800 + i, rng.choice([2, 5, 8, 12, 25])).replace("\n", " ") for i in range(9)] + ["", " "]
    texts = {i: "\n".join(rng.choices(pool, k=rng.randint(0, 12))) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.digest(docs).collect()}
    for i, gone in repeated_lines(texts).items():
        assert got[i] == "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)


# HTML

def test_main_text():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- ad --><div class='ad'>Buy</div><article><header><h1>Head &amp; line</h1></header>"
        "<p>One\n  <b>two</b>&nbsp;<a href='x'>three</a>.<br>Four<p>Short.<aside>See also</aside><div class='share-box'><div>Share</div></div>"
        "<p>&lt;End&gt;</p><form><input>Mail</form></article><div id='comments'><p>Nice!</p></div><footer>&copy; us</footer></body></html>"
    )
    assert html.main_text(page) == "Head & line\nOne two three. Four\nShort.\n<End>"


def test_main_text_without_an_article_element():
    menu = "<div class=menu><a href=1>a</a></div><p><a href=1>link one</a> <a href=2>link two</a></p>"
    body = "".join(f"<p>{frames.prose(i, 25)}</p>" for i in range(3)) + "<p>Short one.</p>"
    expected = [" ".join(frames.prose(i, 25).split()) for i in range(3)] + ["Short one."]
    assert html.main_text(f"<body>{menu}{body}<div class=footer>foot</div>") == "\n".join(expected)


def test_broken_pages():
    assert html.main_text("") == html.main_text("<nav>only a menu") == html.main_text("<script>x") == ""
    assert html.main_text("<article><p>cut off in the foo") == "cut off in the foo"
    assert html.main_text("<article><p>text</article><footer>cut") == "text"
    assert html.main_text("<div class=ad>open<article><p>text</p></article>") == "text"
    deep = "<div>" * 20000 + "<article>x</article>"
    assert html.main_text(deep) == "x"


ARTICLE_LINES = [" ".join(frames.prose(i, 25).split()) for i in range(30, 33)]
BODY = "".join(f"<p>{line}</p>" for line in ARTICLE_LINES)


@pytest.mark.parametrize("name", [
    "layout has-sidebar", "site no-sidebar", "post ad-free", "main-content with-comments", "page-with-banner", "banner", "widget", "share-page",
])
def test_no_article_is_lost_to_the_name_of_a_wrapper(name):
    around = "<div class=sidebar><p>{0}</p></div><div id=comments><article><p>{0}</p></article></div><div class='site-footer'>{0}</div>".format("Reader words here. " * 3)
    for body in (BODY, f"<article>{BODY}</article>", f"<main><div>{BODY}</div></main>"):
        page = f"<html><body><div class=nav>menu</div><div class='{name}'>{body}</div>{around}</body></html>"
        assert html.main_text(page) == "\n".join(ARTICLE_LINES)


def test_long_comments_are_no_article():
    comments = "".join(f"<div class=comment><p>{frames.prose(i, 60)}</p></div>" for i in range(20))
    assert html.main_text(f"<body><div class=text>{BODY}</div><div id=comments>{comments}</div>") == "\n".join(ARTICLE_LINES)
    assert html.main_text(f"<body><div class=text>{BODY}</div><div class='comment-list'>{comments}</div>") == "\n".join(ARTICLE_LINES)


def test_short_articles_and_short_endings():
    assert html.main_text("<body><div class=nav><a href=x>Home</a></div><p>Closed today.</p><div class=footer>Imprint</div>") == "Closed today."
    page = f"<body><div>{BODY}<div class=ad>Buy!</div><p>The end.</p></div><div class=footer>Imprint</div><p>Tail</p></body>"
    assert html.main_text(page) == "\n".join([*ARTICLE_LINES, "The end."])


def test_broken_markup_takes_linear_time():
    for unit in ('<a "', "<script ", "<!--", "<p '\">", "</", "<a b='", "<div class=\"x", "<textarea>", "<"):
        began = time.perf_counter()
        html.main_text(unit * (1_000_000 // len(unit)))
        assert time.perf_counter() - began < 6, unit
    began = time.perf_counter()
    html.main_text('<a "' * 250_000)
    assert time.perf_counter() - began < 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 1, 5, 30, 79, 80, 200]), max_size=40), st.booleans())
def test_line_blocks_against_brute_force(sizes, marked):
    """A line is kept just if it can reach a window with enough text over windows that aren't empty."""
    window = lambda i: sum(sizes[i:i + html.WINDOW])
    n = len(sizes)
    surge = 1 if marked else min(html.SURGE, max([window(i) for i in range(n)], default=0))
    expected = []
    for at in range(n):
        if not sizes[at]:
            continue
        low = high = at
        while low and window(low - 1):
            low -= 1
        while high + 1 < n and window(high + 1):
            high += 1
        if any(window(i) >= surge for i in range(low, high + 1)):
            expected.append(at)
    assert html.kept_lines(sizes, marked) == expected


def test_tags_against_a_plain_reading():
    page = "a < b <p class='x>y'>t</p><!-- <b> --><BR/><script>if (a<b) '</p>'</script ><i\n>u</i> 1<2 <!DOCTYPE x><a href=\"q\">"
    found = [(t.name, t.closes) for t in html.tags(page)]
    assert found == [("p", False), ("p", True), ("", False), ("br", False), ("", False), ("i", False), ("i", True), ("", False), ("a", False)]
