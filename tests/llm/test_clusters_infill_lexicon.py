"""Simplex clustering, fill-in-the-middle and the lexicon encoder against plain versions of what they state."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lakestrata.llm import infill, lexicon, simplex
from lakestrata.llm.queries import QUERIES
from tests.conftest import DATA, rows

VECTORS = "vec_id long, embedding array<double>, label string, cluster int, q string"
DOCS = "doc_id long, text string, n string, form int, ids string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain_clusters(kept, centroids=16, rounds=3):
    """Python integers throughout; ``kept`` holds (vec_id, components) of every vector that takes part."""
    points = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in kept]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in points if i is not None)
    middle = [v for _, v in named[:centroids]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(near(v)[1], []).append(v)
        middle = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else middle[k] for k in range(len(middle))]
    found = [(i, *near(v)[::-1]) for i, v in points]
    inertia = {}
    for _, k, d in found:
        inertia[k] = inertia.get(k, 0) + d
    name = lambda k: hashlib.sha256(",".join(map(str, middle[k])).encode()).hexdigest()
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), name(k)) for i, k, d in found), key=repr)


def clustered(seed, n, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(12, 64)) * 3
    return [(i, (middles[i % 12] + rng.normal(size=64) * spread).tolist()) for i in range(n)]


@pytest.mark.parametrize("kept", [
    clustered(1, 400, 0.2),
    [(i, v) for i, v in clustered(2, 40, 0.5) for _ in range(3)],  # repeated rows
    [(i, [float(i % 3)] * 64) for i in range(50)],  # equal vectors, pivots on one line, ties, empty clusters
    clustered(3, 5, 1.0),  # fewer vectors than centroids
    [(i % 7, v) for i, v in clustered(4, 30, 0.3)],  # vectors that share an id
    [*clustered(5, 30, 0.3), (None, [0.5] * 64)],
    [(i, [(-1.0) ** (i * j) * 2.0**20 + i for j in range(64)]) for i in range(20)],  # large components
])
def test_clusters_are_those_of_plain_integers(spark, kept):
    extra = [(-1, [1.0] * 63, "x", 1, "y"), (-2, None, None, None, None), (-3, [float("nan")] * 64, "x", 1, "y"), (-4, [1.0] * 63 + [None], "x", 1, "y"),
             (-5, [float("inf")] + [0.0] * 63, "x", 1, "y"), (-6, [2.0**21] + [0.0] * 63, "x", 1, "y"), (-7, [], "x", 1, "y")]
    frame = spark.createDataFrame([(i, v, "a", 0, None) for i, v in kept] + extra, VECTORS)
    assert rows(simplex.cluster(frame).drop("n_compared")) == plain_clusters(kept)


def test_no_vectors_make_no_clusters(spark):
    for given in ([], [(1, [1.0], "x", 0, "q")]):
        out = simplex.cluster(spark.createDataFrame(given, VECTORS))
        assert out.collect() == [] and out.dtypes == simplex.cluster(spark.createDataFrame([(1, [1.0] * 64, "x", 0, "q")], VECTORS)).dtypes


def test_simplex_bounds_hold_and_rule_centroids_out(spark):
    rng = np.random.default_rng(9)
    points = np.floor(64 * rng.normal(size=(300, 64))).astype(np.int64)
    flat = points.copy()
    flat[:, 3:] = 0  # all on a plane of three dimensions: most pivots add nothing
    for some in (points, flat, points * (1 << 18)):
        base = simplex.Simplex(some[:16])
        apexes = base.apexes(some)
        true = np.sqrt(simplex.squares(some, some[100:130]).astype(float))
        low, high = simplex.bounds(apexes, apexes[100:130])
        slack = base.slack(np.linalg.norm(apexes, axis=1).max(keepdims=True))
        assert (low - slack <= true).all() and (true <= high + slack).all() and slack[0] < 0.01 * true.max()
    assert len(simplex.Simplex(flat[:16]).base) <= 3
    # Near clusters: most centroids are never compared.
    compared = simplex.cluster(spark.createDataFrame([(i, v, "a", 0, None) for i, v in clustered(1, 400, 0.2)], VECTORS)).agg({"n_compared": "avg"}).first()[0]
    assert compared < 4


TEXTS = [
    (1, "abcdef", "x", 1, "y"), (2, "", "x", 1, "y"), (3, None, None, None, None), (4, "has a <S> mark", "x", 1, "y"), (5, "a", "x", 1, "y"),
    (6, "é漢😀́ ؀ mixed " * 400, "x", 1, "y"), (7, "z" * 100_000 + "漢" * 5_000 + "😀" * 3_000 + "q", "x", 1, "y"), (None, "no id here", "x", 1, "y"),
    (8, "<P", "x", 1, "y"), (9, "<S><", "x", 1, "y"), (1, "abcdef", "x", 1, "y"), (1, "other text of the same id", "x", 1, "y"),
    *((100 + i, "tie > < S> <M " + "äb" * i, "x", 1, "y") for i in range(60)),
]


def plain_infill(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_infill_cuts_like_plain_slices(spark):
    given = spark.createDataFrame(TEXTS, DOCS)
    want = [plain_infill(i, t) for i, t, *_ in TEXTS]
    assert rows(infill.fill_in_middle(given)) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    for _, text, *_ in TEXTS:
        assert all(infill.restore(f, infill.transform((text or "").encode(), infill.RankIndex.of((text or "").encode()), i)[3]) == (text or "").encode()
                   for i in range(30) for f in [infill.transform((text or "").encode(), infill.RankIndex.of((text or "").encode()), i)[0]] if len(text or "") < 1000)
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).collect() == []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows(infill.digests(given)) == sorted(((*w[:5], sha(w[5]), sha(t or "")) for w, (_, t, *_) in zip(want, TEXTS)), key=repr)


def test_rank_index_is_exact_at_every_place_within_its_error(spark):
    rng = random.Random(4)
    for text in ["", "a", "é" * 3000, "".join(rng.choice("aé漢😀") * rng.randrange(1, 400) for _ in range(200)), "".join(rng.choice("aé漢😀") for _ in range(5000))]:
        data = text.encode()
        for error in (0, 3, 100):
            index = infill.RankIndex.of(data, error)
            places = range(len(text) + 1)
            assert index.cut(*places) == [len(text[:k].encode()) for k in places] if len(text) < 6000 else index.chars == len(text)
            y = infill.offsets(data)
            assert (np.abs(index.predict(np.arange(len(y))) - y) <= error + 1).all()
    assert len(infill.RankIndex.of(("a" * 50_000).encode()).begins) == 1
    frame = spark.createDataFrame(TEXTS, DOCS)
    stored = infill.rank_indexes(frame.where("doc_id = 6")).first()
    text = TEXTS[5][1]
    assert infill.stored_index(stored).cut(7, 1000) == [len(text[:7].encode()), len(text[:1000].encode())]


AWKWARD = [
    "", " ", "  two  blanks ", "end ", "\tx", "a\n\nb \n c", "it's we'll 'S", "<|endoftext|>", "a<|endoftext|> b", " <|endoftext|><|endoftext|>", "<|endof", "́é漢字 😀 ٣½",
    "new letters \U00010940 ՘ here", "a" * 5000, "ab" * 3000 + " " + "é" * 2000, " " * 400, "a b c  d\x1c e", "\x00 \x00", " of the of\n the",
]


def awkward_texts():
    rng = random.Random(1)
    signs = [*" \n\t 　\x1c\x85ab'stre.LL1٣é漢😀́", "<|endoftext|>", "<|endo", "the", " of", "'s", "'ll", "\U00010940"]
    return AWKWARD + ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(2000)]


def speller(words):
    merger = lexicon.Merger(TOKENIZER)
    image = lexicon.compile_lexicon(words, merger)
    return lexicon.Speller(merger, lexicon.Lexicon(np.frombuffer(image, np.uint8)))


@pytest.mark.parametrize("words", [[], ["the", "of", "of\n", "é漢", "", "the<|endoftext|>", "b", "c", "blanks"]])
def test_lexicon_encoder_agrees_with_the_library(words):
    library = Tokenizer.from_file(TOKENIZER)
    spell, texts = speller(words), awkward_texts()
    for text, ids in zip(texts, spell.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert spell.decode(ids) == library.decode(want, skip_special_tokens=False)
        assert spell.decimal(ids) == ",".join(map(str, want)).encode()
    assert spell.decode(np.array([50256, 223, 64])) == library.decode([50256, 223, 64], skip_special_tokens=False)


def test_long_merges_are_the_plain_ones():
    merger, rng = lexicon.Merger(TOKENIZER), random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("abtheins é") for _ in range(rng.randrange(1, 48))).encode()[:48]
        assert merger._merge_long([merger.single[b] for b in word]) == merger.merge(word)


def test_transducer_is_exact_and_minimal():
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))).encode(): tuple(rng.choices(range(5), k=rng.randrange(4))) for _ in range(400)}
    found = lexicon.Lexicon.build(words.items())
    probes = [*words, *("".join(rng.choice("abcd") for _ in range(rng.randrange(9))).encode() for _ in range(400))]
    flat = lexicon.Ragged.of(probes, np.uint8)
    hit, ids = found.look_up(flat.values, flat.starts, flat.sizes)
    for p, h, row in zip(probes, hit, np.split(ids.values, ids.starts[1:])):
        assert h == (p in words) and tuple(row) == words.get(p, ())
    # All words of one length with an id for each first letter: one state for each length, whatever the rest.
    same = [(f"{a}{b}{c}".encode(), (i,)) for i, a in enumerate("abc") for b in "xyz" for c in "xyz"]
    states = lexicon.compile_words(sorted(same))
    assert len(states) == 4
    # No two states accept the same endings with the same ids.
    endings = {}
    states = lexicon.compile_words(sorted(words.items()))
    for arcs, ends, rest in states:
        accepted = {((b, *w), (*out, *o)) for b, out, target in arcs for w, o in endings[target]} | ({((), rest)} if ends else set())
        assert accepted not in endings.values()
        endings[len(endings)] = accepted
    assert {bytes(w): o for w, o in endings[len(states) - 1]} == words


def test_frequent_words_come_from_the_automaton(spark):
    """The encoder writes what the file says: with other ids in it, frequent words come out as those."""
    merger = lexicon.Merger(TOKENIZER)
    wrong = lexicon.Lexicon.build([(b" the", (7, 8))])
    assert next(iter(lexicon.Speller(merger, wrong).encode(["of the"]))).tolist() == [*merger.merge(b"of"), 7, 8]


def test_lexicon_operator_reads_all_rows(spark):
    given = [(i, t, "x", 1, "y") for i, t in enumerate(AWKWARD)] + [(None, "no id", "x", 1, "y"), (70, None, None, None, None), (3, "repeated", "x", 1, "y"), (3, "repeated", "x", 1, "y")]
    frame = spark.createDataFrame(given, DOCS).repartition(3)
    library = Tokenizer.from_file(TOKENIZER)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in given]
    encoded = lexicon.encode(frame, TOKENIZER, most=3)
    assert rows(encoded) == sorted(((i, ids) for i, ids, _ in want), key=repr)
    assert rows(lexicon.decode(encoded, TOKENIZER)) == sorted(((i, t) for i, _, t in want), key=repr)
    empty = spark.createDataFrame([], DOCS)
    assert lexicon.encode(empty, TOKENIZER).collect() == [] and lexicon.round_trip(empty, TOKENIZER).collect() == []
    assert lexicon.frequent_words(spark.createDataFrame([(1, "a b b c", "", 1, ""), (2, "x c d", "", 1, "")], DOCS), 3) == ["b", "c", "d"]


def test_lexicon_query_agrees_with_the_library(spark):
    library = Tokenizer.from_file(TOKENIZER)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert rows(QUERIES["op13_lexicon_bpe"](spark, DATA)) == sorted(want, key=repr)
