"""The operators against plain versions of what they state, on small frames with the awkward rows in them."""

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lakestrata.llm import bpe, chat, minhash, packing, pivots, postings, quality, shared, substrings, tokenfile, toxicity
from lakestrata.llm.queries import ORACLE, QUERIES
from lakestrata.llm.shared import Memo, components
from tests.conftest import DATA

KIND = "doc_id long, text string, lang string, score double, component_id string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
random.seed(7)
BASE = " ".join(random.choice("abcdefgh") + str(random.randint(0, 99)) for _ in range(400))
ROWS = [
    (1, BASE, "en", 0.0, "x"), (2, BASE, "en", 0.0, "x"), (2, BASE, "en", 0.0, "x"), (3, BASE.replace("a1", "zz", 2), "en", 0.0, "x"),
    (4, None, None, None, None), (5, "", "en", 0.0, "x"), (6, " \t\n ", "en", 0.0, "x"), (7, "one two", "en", 0.0, "x"),
    (8, "one two", "en", 0.0, "x"), (None, BASE, "en", 0.0, "x"), (9, "w " * 3000 + BASE[:900], "en", 0.0, "x"), (10, "ÄÖ é  x y\n\n", "de", 0.0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = con.execute(ORACLE[name])
    columns = sorted(got.columns)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_chat_round_trip(spark):
    turns = [(1, 2, "user", "a<|im_sep|>\\"), (1, 1, "user", "<\\|im_end|>"), (1, 3, "assistant", None), (1, 4, "a\nb<|", "x"), (1, 5, "assistant", "ü<|"), (None, None, None, None)]
    out = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    read = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    found = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in read}
    assert found[1] == ([("user", "<\\|im_end|>"), ("user", "a<|im_sep|>\\"), ("assistant", ""), ("a\nb<|", "x"), ("assistant", "ü<|")], "ü<|")
    assert found[None] == ([("", "")], "")
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_bpe_agrees_with_the_library_and_keeps_tables_exact(spark, docs, none):
    ranks = bpe.Ranks.load(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    parts = ["a", " ", "the", "\n", "é", "中", "12", "'ll", "!", "\x1c", "　", "aaaaaa", "=" * 60, "\U0001f600", "<|endoftext|>"]
    for text in ["".join(random.choices(parts, k=random.randint(0, 50))) for _ in range(300)] + [r[1] or "" for r in ROWS]:
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids).decode() == text
    for _ in range(60):
        data, new = ("".join(random.choices(parts, k=25)).encode() for _ in range(2))
        table = bpe.PrefixTable(ranks, data)
        assert table.ids() == ranks.merge(data)
        a, b = sorted(random.choices(range(len(data) + 1), k=2))
        table.replace(a, b, new[:7])
        table.append(b"ing")
        assert table.ids() == ranks.merge(data[:a] + new[:7] + data[b:] + b"ing")
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN).count() == len(ROWS)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_file_gives_any_token(spark, docs, none, tmp_path):
    ids = np.array([0, 255, 256, 65535, 65536, 2**24, 7] * 300, np.uint32)
    codes = tokenfile.Codes(*tokenfile.pack(ids))
    assert (codes.tokens(0, len(ids)) == ids).all() and [codes.token(i) for i in range(900)] == ids[:900].tolist()
    assert (codes.tokens(513, 1500) == ids[513:1500]).all() and not len(tokenfile.Codes(*tokenfile.pack(ids[:0])))
    json = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenfile.WordEncoder(json)
    texts = [r[1] or "" for r in ROWS] + ["a <|endoftext|> b", "<|endoftext|>", " x", "x ", "a\n b"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [x.ids for x in encoder.library.encode_batch(texts, add_special_tokens=False)]
    tokenfile.write(docs, str(tmp_path / "t"), json, 2)
    found = sorted((tuple(r) for r in tokenfile.read_documents(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]
    tokenfile.write(none, str(tmp_path / "n"), json, 2)
    assert tokenfile.read_documents(spark, str(tmp_path / "n")).count() == 0


def test_minhash_links(spark, docs, none):
    found = {(r["doc_id"], r["component_id"], r["kept"], r["n_shingles"] > 0) for r in minhash.similar_documents(docs).collect()}
    assert {(1, 1, True, True), (2, 1, False, True), (3, 1, False, True), (4, 4, True, False), (5, 5, True, False), (6, 6, True, False), (7, 7, True, True), (8, 7, False, True), (None, None, True, True), (9, 9, True, True)} <= found
    assert minhash.similar_documents(none).count() == 0


def test_minhash_blocks_pair_a_bucket_across_components(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(3)
    texts = [" ".join("other" if rng.random() < 0.03 else w for w in BASE.split()) for _ in range(40)]
    rows = minhash.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("component", F.col("doc_id") % 9)
    crowd = rows.select("doc_id", F.explode("bands").alias("key")).groupBy("key").agg(F.collect_list("doc_id").alias("ids"), F.count("*").alias("n")).where("n > 1")
    opened = crowd.select("key", "n", F.explode("ids").alias("doc_id")).join(rows, "doc_id")
    found = sorted(map(tuple, minhash.pairs_across(opened).collect()))
    meets = (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.component") != F.col("b.component")) & F.arrays_overlap("a.bands", "b.bands")
    plain = rows.alias("a").join(rows.alias("b"), meets & minhash.may_match("a", "b")).select("a.doc_id", "b.doc_id")
    assert found == sorted(map(tuple, plain.collect())) and len(found) > 20


def test_automaton_matches_every_window():
    for _ in range(40):
        texts = [random.choices("ab", k=random.randint(1, 40)) for _ in range(3)]
        automaton = substrings.Automaton()
        for t in texts:
            automaton.add(t)
        read = random.choices("ab", k=60)
        covered = {k for a, b in automaton.spans(read, 6) for k in range(a, b)}
        windows = {tuple(t[i : i + 6]) for t in texts for i in range(len(t) - 5)}
        assert covered == {k for i in range(55) if tuple(read[i : i + 6]) in windows for k in range(i, i + 6)}


def test_substrings_by_brute_force(spark, docs, none):
    first = {}
    for d, text, *_ in ROWS:
        w = words(text)
        for i in range(len(w) - 49):
            if d is not None:
                first[tuple(w[i : i + 50])] = min(d, first.get(tuple(w[i : i + 50]), d))
    want = []
    for d, text, *_ in ROWS:
        w = words(text)
        gone = {k for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for k in range(i, i + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.digests(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    out = substrings.remove(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert substrings.digests(none).count() == 0


def test_packing_fits_and_loses_nothing(spark, docs, none):
    out = packing.pack(docs, packing.word_count(F.col("text"))).collect()
    assert sum(r["size"] for r in out) == sum(len(words(r[1])) for r in ROWS)
    bins = {}
    for r in out:
        bins.setdefault((r["pack_group"], r["bin"], r["capacity"]), []).append(r["size"])
    assert all(sum(v) <= k[2] and k[2] in packing.LENGTHS for k, v in bins.items())
    assert packing.pack(none, packing.word_count(F.col("text"))).count() == 0
    where, final = packing.Packer((4, 8)).pack([4, 4, 3, 1, 5, 3])
    assert sum(final) == 20 and len(where) == 6


def test_vectors_that_take_no_part(spark):
    v = [float(i) for i in range(1, 9)]
    near = [x + 0.01 for x in v]
    rows = [(1, v, 0), (2, near, 0), (2, near, 0), (3, v, 1), (4, None, 0), (5, [0.0] * 8, 0), (6, [float("nan")] * 8, 0), (7, v, None), (8, [None] * 8, 0), (20, v, 0), (None, v, 0), (9, v[:3], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit("x"))
    found = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_duplicates(frame, 0.93).collect()}
    assert {(1, 2, 1, True), (2, 2, 1, False), (20, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (6, 0, 6, True), (7, 0, 7, True), (9, 0, 9, True)} <= found
    got = [tuple(r)[:3] for r in postings.nearest(frame, F.col("vec_id") % 20 == 0, 3).orderBy("rank").collect()]
    assert got == [(20, 1, 2), (20, 2, 1), (20, 3, 3)]
    assert postings.nearest(frame.limit(0), F.col("vec_id") % 20 == 0, 3).count() == 0
    assert pivots.near_duplicates(frame.limit(0), 0.93).count() == 0


def test_posting_lists_recall(spark):
    frame = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    data = sorted((r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect())
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
    asked = np.flatnonzero(ids % 20 == 0)
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -9
    want = {(int(ids[a]), int(ids[b])) for a, row in zip(asked, np.argsort(-scores, axis=1)[:, :20]) for b in row}
    got = {(r["query_id"], r["vec_id"]) for r in postings.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_channel_restores_disguised_words():
    costs = -np.log(np.full((28, 28, 28), 1 / 28))
    for seen in ("1d10t", "i.d.i.o.t", "idiiiot", "i d i o t"):
        assert "idiot" in toxicity.restored_words(seen, costs) or "ldlot" in toxicity.restored_words(seen, costs), seen
    assert toxicity.restored_words("plain", costs) == ["plain"]
    assert toxicity.spelled("so i d i o t x y".split()) == ["i d i o t x y"]


def test_channel_restores_mixed_spellings_and_keeps_clean_words():
    # A character model that has seen the words, as a corpus would show them.
    counts = toxicity.trigram_counts(b"moron idiot loser clown slut killer good night soon such well known hello in the hall " * 50)
    costs = -np.log((counts.reshape(28, 28, 28) + 0.01) / (counts.reshape(28, 28, 28).sum(2, keepdims=True) + 0.28))
    known = {f"={w}": i for i, w in enumerate(("moron", "idiot", "loser", "clown", "slut", "killer"))}
    find = toxicity.Finder(costs, known)
    seen = {
        "moron": ["m 0 r 0 n", "m.0.r.0.n", "mo.ron", "mo ron", "M0 ron!", "mmoorroonn", "(m0r0n)", "i a m 0 r 0 n x", "m. 0. r. 0. n."],
        "idiot": ["i d 1 0 t", "i.d.1.0.t", "id-iot", "id iot", "iddiioott", "1d10t", "i d - 1 0 t"],
        "loser": ["l 0 s 3 r", "l00s3r", "lo_ser", "l000ser"], "clown": ["c l 0 w n", "(lown", "cl..own"], "slut": ["$lut", "$ l u t", "$$lut"], "killer": ["k1113r", "k 1 1 1 3 r"],
    }
    for word, spellings in seen.items():
        for text in spellings:
            assert known[f"={word}"] in find(f"well {text} hello"), text
    for text in ("good night", "well-known hello!", "soon such in the hall", "4 5 5", "mo in ron", "a.b 3.14 1st"):
        assert find(text) == set(), text
    for token in ("good", "hello!", "well-known", "1st"):  # what is written stays beside what it may mean
        assert set(re.findall("[a-z]+", token)) <= set(toxicity.restored_words(token, costs))
    # Decoding only what may hold a known feature finds the same as decoding all.
    letters = random.Random(2)
    for _ in range(3000):
        token = "".join(letters.choices("moridtlsen0135$!.-", k=letters.randint(1, 9)))
        every = {known[f] for w in toxicity.restored_words(token, costs) for f in toxicity.word_features(w) if f in known}
        assert set(find._token(token)) == every
        assert set((find._value(token, toxicity.folded(token)) or ((),))[0]) == every
    # So it does with beginnings of words, and for whole texts, whatever was read before.
    known |= {f"^{w[:n]}": 6 + n for w in ("moron", "idiot") for n in (3, 4)}
    find, plain = toxicity.Finder(costs, known), toxicity.Finder(costs)
    find.limit = 50
    for _ in range(1500):
        text = " ".join("".join(letters.choices("moridtlsen0135$!.-ß²%", k=letters.randint(1, 9))) for _ in range(letters.randint(1, 12)))
        every = {known[f] for f in plain(text) if f in known}
        assert every <= find(text) and len(find.newer) <= 62


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    texts = [b"", b" ", b"a", b"a a\tb\x0b a  ", b"x" * 9000 + b" y", *(bytes(rng.choices(b"ab \n\xc3\xa9", k=200)) for _ in range(200))]
    seen = {}
    for text in texts:
        words = text.split()
        hashes = shared.word_hashes(text).tolist()
        assert len(hashes) == len(words)
        for w, h in zip(words, hashes):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len({w for t in texts for w in t.split()})
    long = b" ".join(bytes(rng.choices(b"abc", k=rng.randrange(1, 40))) for _ in range(150_000))
    assert len(long) > shared.PIECE and (shared.word_hashes(long) == np.concatenate([shared.word_hashes(w) for w in long.split()])).all()


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifiers_on_held_out_rows(spark, docs, none, kind):
    folder = DATA.replace("sf0.001", "sf0.1")
    given, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    column = "quality" if kind is quality else "toxic"
    model = kind.train(given, labels)
    held = kind.score(given.join(labels, "doc_id", "left_semi"), model).where(kind.held_out()).join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0]
    assert right > 0.95
    scored = kind.score(docs, model).collect()
    assert len(scored) == len(ROWS) and all(0 <= r["score"] <= 1 for r in scored)
    assert kind.score(none, model).count() == 0
    blank = kind.train(docs, labels.limit(0))  # nothing to learn from: every document stays
    keep = quality.keep_good if kind is quality else toxicity.keep_clean
    assert keep(docs, blank).count() == len(ROWS)


def test_pipeline_keeps_columns_and_takes_effect(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", F.lit("x")).withColumn("score", F.lit(1))
    sizes = [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, DATA)
        assert out.columns == rows.columns, name
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage-{len(sizes)}")
        rows = spark.read.parquet(path)
        sizes.append(rows.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, DATA)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_components_of_chains_rings_and_stars(spark):
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(150, 260)] + [(300, 301), (301, 302), (302, 300), (7, 7)]
    edges += [tuple(map(int, p)) for p in rng.integers(1_000, 1_400, (230, 2))]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_memo_keeps_what_is_asked_for_often():
    made = []
    memo = Memo(lambda k: made.append(k) or k * 2, 10)
    for k in range(100):
        assert (memo[k], memo[-1]) == (k * 2, -2)
    assert made.count(-1) == 1 and len(memo) + len(memo.older) <= 10
