"""Token ids, leaked passages and truncated texts."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gapweave.llm import leaks as L
from gapweave.llm import truncation as T
from gapweave.llm.leaks import leaks
from gapweave.llm.text_queries import p7_ids
from gapweave.llm.tokens import VOCABULARY, cuts, decode, encode, encoder, token_ids
from gapweave.llm.truncation import parts, truncated, without_marks

ENC = encoder(open(VOCABULARY, "rb").read())
CHARS = st.text(st.sampled_from(list("ab'stre 1.\n\t\\é漢𝔸<|>\u3000\x1c\x85")) | st.characters(codec="utf-8"), max_size=120)


# -- token ids ---------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(CHARS, st.integers(1, 20))
def test_pieces_give_the_ids_of_the_whole(text, size):
    assert encode(ENC, text, size).tolist() == ENC.encode_ordinary(text)
    places = cuts(text, size)
    assert places is not None and places == sorted(set(places))


def test_ids_equal_another_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    rng = random.Random(1)
    texts = [None, "", " ", "a" * 500, "ab cd " * 300, "x\n\n  y" * 200, "<|endoftext|> é漢字 " * 50, " " * 400 + "b", "".join(rng.choice("ab \n\t'1.é漢") for _ in range(3000))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for spread in (1_000_000, 100):
        got = {r["doc_id"]: r["ids"] for r in token_ids(df, "doc_id", "text", piece_chars=7, spread_chars=spread, overlap_chars=20).collect()}
        assert got == {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in decode(token_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "k long, text string")
    assert sorted((r["k"] is None, len(r["ids"])) for r in token_ids(df, "k", "text").collect()) == [(False, 2), (False, 2), (True, 1)]
    assert token_ids(df.where("false"), "k", "text").count() == 0
    # Long texts alike: every row is a row, whatever keys it shares.
    texts = ["one two " * 50, "three four five " * 40, "x" * 300, None]
    long = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (1, texts[0]), (None, texts[1]), (None, texts[2]), (2, texts[3])], "k long, text string")
    got = sorted((r["k"] or 0, r["ids"]) for r in token_ids(long, "k", "text", spread_chars=100, overlap_chars=20).collect())
    assert got == sorted((k, ENC.encode_ordinary(t) if t else []) for k, t in [(1, texts[0]), (1, texts[1]), (1, texts[0]), (0, texts[1]), (0, texts[2]), (2, None)])


def test_query_with_a_text_of_over_a_million_characters(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdeé漢", k=rng.randint(1, 9))) for _ in range(400_000))
    assert len(long) > 2_000_000
    spark.createDataFrame([(1, long), (1, "short"), (None, long[:1_500_000])], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(r["ids"] for r in p7_ids(spark, f"file://{tmp_path}").collect())
    assert got == sorted(ENC.encode_ordinary(t) for t in (long, "short", long[:1_500_000]))


# -- leaks -------------------------------------------------------------------------------------------


def words(t):
    return re.findall("[a-z0-9]+", re.sub(r"\\[a-z]*", " ", t.lower())) if t else []


def brute_leaks(docs, items, span):
    def grams(t):
        w = words(t)
        return {tuple(w[i : i + span]) for i in range(len(w) - span + 1)}

    g = [(k, grams(t)) for k, t in items if k is not None]
    return {(d, k) for d, t in docs if d is not None for k, x in g if grams(t) & x}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abcZ19 \\\n.{é"))), max_size=6), st.integers(1, 30))
def test_word_hashes(texts, at_once):
    h, of = L.word_hashes(texts, at_once)
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert of.tolist() == [i for i, _ in want]
    assert len({*zip(h.tolist(), [w for _, w in want])}) == len({w for _, w in want}) == len(set(h.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=40), st.integers(3, 6), st.integers(0, 3))
def test_winnowing_guarantee(a, b, span, less):
    gram = span - less
    if gram < 1:
        return
    hashed = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sides = []
    for v in (a, b):
        w = hashed[np.array(v, int)] if v else np.zeros(0, np.uint64)
        of = np.zeros(len(w), np.int64)
        h, at = L.fingerprints(w, of, gram, span)
        sides.append((h, L.contexts(w, of, at, gram, span)))
    shared = {tuple(a[i : i + span]) for i in range(len(a) - span + 1)} & {tuple(b[i : i + span]) for i in range(len(b) - span + 1)}
    hits = [(x, y) for x in range(len(sides[0][0])) for y in range(len(sides[1][0])) if sides[0][0][x] == sides[1][0][y]]
    ok = any(L.spans_match(sides[0][1][x][None], sides[1][1][y][None], gram, span)[0] for x, y in hits)
    assert ok == bool(shared)


@pytest.mark.parametrize("limit", [L.BROADCAST_CHARS, 0])
def test_leaks_against_brute_force(spark, limit):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Alpha", "x1"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " \\alpha{} ", "$", " \\\\ "]) for _ in range(n))

    items = [(i, text(rng.randint(5, 40))) for i in range(25)] + [(90, None), (91, ""), (None, text(30)), (3, text(20))]
    docs = []
    for i in range(60):
        t = text(rng.randint(0, 80))
        if rng.random() < 0.6:
            w = rng.choice(items[:25])[1]
            a = rng.randint(0, len(w) // 2)
            t += w[a : a + rng.randint(10, len(w))].upper() + text(5)
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, "one two"), (None, items[0][1]), (203, items[0][1] * 50), (203, items[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, _key int")
    e = spark.createDataFrame([(*x, "s", "t") for x in items], "item_id int, item_text string, suite string, text string")
    got = {tuple(r) for r in leaks(d, "doc_id", "text", e, "item_id", "item_text", broadcast_chars=limit).collect()}
    assert got == brute_leaks(docs, items, 12)
    assert len(got) > 5
    assert leaks(d.where("false"), "doc_id", "text", e, "item_id", "item_text", broadcast_chars=limit).count() == 0
    assert leaks(d, "doc_id", "text", e.where("false"), "item_id", "item_text", broadcast_chars=limit).count() == 0


# -- truncation --------------------------------------------------------------------------------------

OPEN = [
    "\\begin{document}\nDone.",
    "\\begin{document}\nDone.\n%\\end{document}",
    "Text.\n\\begin{align*}\n x &= y",
    "We have $x + ",
    "Then\n\\[ a = b",
    "A line.\n\n@article{key,\n  title = {On a",
    "See \\cite{ab",
    "Words \\sect",
    "Text.\n\\begin{ﬁgure}[t]\n\\caption{Done.}",
    "\\newcommand{\\R}{\\mathbb{R",
    "\\begin{document}\n\\begin{abstract}\nDone.\n\\end{abstract}\nMore. \\[ x \\]\n\n--- connection closed ---",
]
CLOSED = [
    "\\begin{document}\nDone.\n\\end{document}\n% vim: set tw=80\n",
    "\\begin{document}\nDone.\n\\end{document}\n\nleft over notes, not set",
    "Text.\n\\begin{align*}\n x &= y\n\\end{align*}",
    "Text.\n%\\begin{figure}\n\\[ a = b \\]\n\n\n",
    "@article{key,\n  title = {On a},\n}\n",
    "@article{key,\r\n  title = {On a},\r\n}\r\n",
    "\\newcommand{\\R}{\\mathbb{R}}\n\\def\\eps{\\varepsilon}",
    "\\DeclareMathOperator{\\x}{x}\n\\endinput\n",
    "\\iffalse\n\\begin{figure}\n\\fi\n\\begin{ﬁgure}\nx\n\\end{figure}",
]


def last_state(text):
    main = parts(text)[0]
    return T.place_states(main)[-1] if main else None


@pytest.mark.parametrize("text", OPEN)
def test_open_markup(text):
    assert last_state(text) in (T.IN_DOCUMENT, T.IN_ENVIRONMENT, T.IN_FORMULA, T.IN_BRACES) or text.endswith("\\sect")


@pytest.mark.parametrize("text", CLOSED)
def test_closed_markup(text):
    assert last_state(text) in (T.AFTER_ENVIRONMENT, T.AFTER_FORMULA, T.AFTER_COMMAND, T.AFTER_ENTRY, T.AFTER_DOCUMENT)


def test_states_of_places():
    got = T.place_states("a $x$ {b\n\nc} \\[y\\] \n\\input{d}\nz")
    names = {"a": T.PLAIN, "x": T.IN_FORMULA, "b": T.IN_BRACES, "c": T.IN_EARLIER_BRACES, "y": T.IN_FORMULA, "d": T.IN_BRACES, "z": T.PLAIN}
    text = "a $x$ {b\n\nc} \\[y\\] \n\\input{d}\nz"
    assert {c: got[text.rindex(c)] for c in names} == names
    assert got[text.index("]")] == T.AFTER_FORMULA and got[text.rindex("}")] == T.AFTER_COMMAND
    assert last_state("A \\textbf{brace\n\nof an earlier paragraph") == T.IN_EARLIER_BRACES
    assert len(T.place_states("")) == 0


def test_parts():
    assert parts("A finished sentence.") == ("A finished sentence.", "", False)
    assert parts(" \n\t ")[0] == parts("\ufffd…")[0] == ""
    assert parts("Done.\n% a note") == ("Done.", "% a note", True)
    assert parts("Done. % a note\nMore") == ("Done. \nMore", "% a note", False)
    main, notes, inside = parts("Done.\n\\iffalse\nA draft that sto")
    assert main == "Done." and notes.endswith("A draft that sto") and inside


def test_marks_are_taken_off():
    for mark in ("…", "...", " [...]", "\n--- connection closed ---", "\ufffd", "   \n", "…\n\n", "\n" + "=" * 90 + " any words " + "=" * 90):
        assert without_marks("the end of it" + mark) == "the end of it"
    for kept in ("see (below)", "See also [more]", "\\[ x \\]", "a -- b", "x \\\\", "\\end{align*}", "so -- he said -- it"):
        assert without_marks(kept) == kept
    assert without_marks("the end of it [cut] \n", True) == "the end of it"


def test_notices_are_learned(spark):
    texts = [f"Some text {i} that sto [cut at {i}]" for i in range(3)] + [f"As shown [see {i}] and [see {i}] by all of them [see {i}]" for i in range(3)] + ["See also [more]", None, "x []"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in T.notices(df, "t").collect()] == ["[cut at 0]"]


def test_valley():
    bins, counts = np.array([-8, -7, -6, -1, 12, 13, 20]), np.array([5, 9, 4, 1, 20, 30, 9])
    assert 0.2 < T.valley(bins, counts) < 3


def sentences(rng, n):
    nouns, verbs = ["model", "kernel", "orbit", "metric", "lattice"], ["grows", "splits", "decays", "aligns"]
    return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} near the {rng.choice(nouns)}, e.g. at {rng.randint(1, 99)}.{rng.randint(1, 9)} units{rng.choice('.?.')}" for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    rows, cut = [], set()
    for i in range(600):
        t = sentences(rng, rng.randint(2, 8))
        if rng.random() < 0.15:
            t = t[: rng.randint(len(t) // 3, len(t) - 8)]
            if re.search(r"(?<![e.g\d])[.?]\s*$", t) is None:
                cut.add(i)
            t += rng.choice(["", "…", " [...]", "\n--- connection closed ---"])
        rows.append((i, t, rng.choice(["a", "b", None]), rng.choice(["en", "EN", None]), "x"))
    rows += [(1000, None, "a", "en", "x"), (1001, "", "a", "en", "x"), (1002, " \n", None, None, "x"), (None, "Cut in the mid", "a", "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, verdict string")
    out = truncated(df, "doc_id", "text", "source", "lang").collect()
    assert len(out) == len(rows)
    found = {r["doc_id"] for r in out if r["truncated"]} - {None}
    assert not found & {1000, 1001, 1002}
    assert all((r["odds"] is None) == (r["doc_id"] in (1000, 1001, 1002)) for r in out)
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.05 * len(cut)


def test_truncated_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert truncated(df, "doc_id", "text", "source", "lang").count() == 0


def test_contexts_are_exact():
    texts = ["Some wörds, 漢字 and 12.5 more.\n", "", "x", "yz", "", "$a$ tail", "q"]
    states = [T.place_states(t) for t in texts]
    places = T.contexts(texts, states).tolist()
    want = []
    for t, s in zip(texts, states):
        codes = [0, 0, *T._codes(t).tolist()]
        want += [((int(s[n]) * 69 + codes[n + 2]) * 69 + codes[n + 1]) * 69 + codes[n] for n in range(len(t))]
    assert places == want and T._KINDS == 69
    for t in ("x", "yz", "abc"):
        assert T.contexts([t], [T.place_states(t)]).tolist() == T.contexts(["w" * 9, t], [T.place_states("w" * 9), T.place_states(t)]).tolist()[9:]
    closed = "a\n\\end{x}\n\n"
    assert T.contexts([closed], [T.place_states(closed)])[-1] == T.AFTER_ENVIRONMENT * 69**3
    held = []
    for part in (places[:9], places[9:]):
        T.tally(np.array(part), held)
    numbers, n = T.summed(held)
    assert dict(zip(numbers.tolist(), n.tolist())) == {x: want.count(x) for x in want}
