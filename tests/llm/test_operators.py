"""Corpus operators on small fixtures: nulls, empty and very long texts, ties, repeated rows, empty tables, odd columns;
and against brute force."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataflow.llm import components, fertility, ivfpq, langid, lsh_forest, mixing, ngram_lm, packing, queries, quotes, sharding, toxicity
from strataflow.llm.common import Ragged, WordHasher, WordTable, shared_dir

SF = "/root/testdata/sf0.001"
WORD_BPE, MODELS = public_tokenizers.path("word_bpe_49k.json"), queries.VOCABULARIES
ODD = [
    (1, "one two three four five six seven eight", "en", "a", 9, "x"), (1, "one two three four five six seven eight", "en", "a", 9, "x"), (2, None, None, None, None, None),
    (3, "", "en", "", 0, None), (4, " \n\t ", "fr", "b", 3, ""), (None, "no id here but some words", "en", "a", 5, "y"), (5, "word " * 30_000, "de", "b", 150_000, "z"),
    (6, "x" * 50_000, "en", "a", 50_000, "z"), (7, "日本語のテキスト 12345 !!! <|endoftext|> ok", "ja", "c", 20, "z"), (8, "Ünïcödé, déjà-vu. don't stop's 'tis\x1f\x85 odd", "en", "a", 3, "q"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sharding_counts_and_slots(spark, odd, empty):
    rows = sharding.hilbert_shards(odd, shards=4).toPandas()
    assert len(rows) == len(ODD) and sorted(rows.position) == list(range(len(ODD)))
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sharding.hilbert_shards(empty).count() == 0


def test_sharding_follows_the_curve_and_splits_hot_ids(spark, monkeypatch):
    """Long common prefixes tell values apart; one doc_id with a third of the rows is many pieces; names don't clash."""
    monkeypatch.setattr(sharding, "PIECE_ROWS", 20)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("https://a-long-prefix/"), F.col("id") % 50).alias("source"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("n_chars"), F.lit("mine").alias("_piece"), F.lit(1).alias("Hilbert_"))
    placed = sharding.hilbert_shards(rows, ("source", "n_chars"), 4)
    assert placed.columns == [*rows.columns, "hilbert", "position", "shard", "slot"]
    got = placed.toPandas().sort_values("position")
    assert (got.hilbert.diff().dropna() >= 0).all() and list(got.position) == list(range(3000)) and got.hilbert.nunique() > 150
    assert (got.groupby("shard").size() == 750).all() and (got["_piece"] == "mine").all()


def test_hilbert_curve_steps_by_one(spark):
    side = 8
    grid = spark.range(side**3).select(*[(F.floor(F.col("id") / side**k) % side).alias(f"c{k}") for k in range(3)])
    rows = grid.select("*", sharding.hilbert_index([F.col(f"c{k}") for k in range(3)], 3).alias("h")).orderBy("h").toPandas()
    assert list(rows.h) == list(range(side**3))
    steps = np.abs(np.diff(rows[["c0", "c1", "c2"]].to_numpy(), axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_packing_round_trip(spark, odd, empty):
    rows = packing.pack(odd, WORD_BPE).toPandas()
    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = collections.Counter((i, t) for i, t, *_ in ODD)
    assert rows.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
    for (i, t), n in texts.items():
        own = rows[rows.doc_id.isna() if i is None else rows.doc_id == i].sort_values("start")
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert own.length.sum() == n * len(want)
        if n == 1:
            assert np.frombuffer(b"".join(own.token_ids), "<u4").tolist() == want
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    limits = packing.Limits(tokens=100, segments=4, loss_tokens=60, max_gap=2, window=50)
    packer, out, total = packing.Packer(limits), [], 0
    for i in range(2000):
        ids = np.arange(rng.integers(1, 150), dtype="<u4")
        total += len(ids)
        out += list(packer.add(i, ids.tobytes(), int(rng.integers(0, 150))))
    out += list(packer.finish())
    assert sum(p[2] for s in out for p in s) == total
    assert all(sum(p[2] for p in s) <= 100 and len(s) <= 4 and sum(p[3] for p in s) <= 60 for s in out)


def largest_fit(items, limits):
    """Sequences that take the largest waiting item that fits, whatever its loss."""
    left, n = sorted(items, reverse=True), 0
    while left:
        room, loss, seats, kept = limits.tokens, limits.loss_tokens, limits.segments, []
        for t, x in left:
            if t <= room and x <= loss and seats:
                room, loss, seats = room - t, loss - x, seats - 1
            else:
                kept.append((t, x))
        left, n = kept, n + 1
    return n


def test_packing_weighs_both_demands():
    """Answers of 60 tokens that all bear loss and prompts of 50 that bear none, with room for 100 and 60: the dot product
    pairs what the largest fit leaves apart."""
    limits = packing.Limits(tokens=110, segments=8, loss_tokens=60, max_gap=200, window=400)
    rng = np.random.default_rng(2)
    items = [(60, 60 if i % 2 else 58) for i in range(100)] + [(50, 0)] * 60 + [(52, 50)] * 40
    packer, out = packing.Packer(limits), []
    for k in rng.permutation(len(items)).tolist():
        t, loss = items[k]
        out += list(packer.add(k, np.zeros(t, "<u4").tobytes(), t - loss))
    out += list(packer.finish())
    assert sum(len(x) for x in out) == len(items)
    assert len(out) <= largest_fit(items, limits)
    assert sum(len(x) > 1 for x in out) >= 60  # each prompt has an answer's company


def test_packing_marks_prompts(spark):
    docs = spark.createDataFrame([(1, "one two three\nfour five, six."), (2, "no line feed here"), (3, "\nall answer"), (4, None)], "doc_id bigint, text string")
    rows = packing.pack(docs, WORD_BPE).groupBy("doc_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss")).collect()
    assert {r["doc_id"]: (r["n"], r["loss"]) for r in rows} == {1: (9, 6), 2: (5, 4), 3: (3, 2), 4: (1, 0)}


def test_mixing_is_poisson_and_seeded(spark, odd, empty):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    rows = mixing.poisson_mix(many, {"a": 3.0, "b": 1.0, None: 1.0}, size=40_000)
    got = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(got["a"] - 24_000) < 800 and abs(got["b"] - 8_000) < 500 and abs(got[None] - 8_000) < 500
    again = mixing.poisson_mix(many.repartition(7), {"a": 3.0, "b": 1.0, None: 1.0}, size=40_000)
    assert rows.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).isEmpty()
    counts = collections.Counter(r["copies"] for r in rows.where("source = 'b' and copy = 0").collect())
    rate = 8_000 / 6_667
    for k in (1, 2, 3):
        assert abs(counts[k] / 6_667 - math.exp(-rate) * rate**k / math.factorial(k)) < 0.02
    assert mixing.poisson_mix(odd, measure="bytes").where("copies < 1").count() == 0
    assert mixing.poisson_mix(empty).count() == 0
    clash = odd.withColumnsRenamed({"score": "_cdf", "lang": "_u"})
    assert mixing.poisson_mix(clash).columns == [*clash.columns, "rate", "copies", "copy", "shuffle_key"]


def test_mixing_inverts_large_rates(spark, monkeypatch):
    """One document among many: its table has the length of the root of its rate; null and '' are two sources; the salted
    join gives the same rows."""
    many = spark.range(200_001).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") == 0, "rare").when(F.col("id") % 2 == 0, "").alias("source"))
    rows = mixing.poisson_mix(many)
    got = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == {"rare", "", None} and all(abs(n - 66_667) < 1500 for n in got.values())
    tables = mixing.poisson_tables(mixing.source_rates(many, None, None, "rows"))
    assert tables.agg(F.max(F.size("cdf"))).first()[0] < 30 * 66_667**0.5
    monkeypatch.setattr(mixing, "BROADCAST_DOUBLES", 0)
    assert rows.select("doc_id", "copy").exceptAll(mixing.poisson_mix(many).select("doc_id", "copy")).isEmpty()


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 400.0, 90_000.0])
def test_poisson_tables_against_sums(spark, rate):
    row = mixing.poisson_tables(spark.createDataFrame([("x", rate)], "s string, rate double")).first()
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(int(rate + 20 * rate**0.5 + 60))]
    sums = np.cumsum(np.exp(logs))
    assert np.abs(np.array(row["cdf"]) - sums[row["least"] : row["least"] + len(row["cdf"])]).max() < 1e-9


def brute_repeats(words, window=8):
    spans = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    seen = collections.Counter(spans)
    return len({i + j for i, s in enumerate(spans) if seen[s] > 1 for j in range(window)})


def test_fertility_against_brute_force(spark, odd, empty, docs):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=MODELS[0])
    for frame in (odd, docs):
        texts = collections.defaultdict(list)
        for r in frame.select("doc_id", "text").collect():
            texts[r[0]].append(r[1])
        for r in fertility.fertility(frame, MODELS).collect():
            raw = texts[r["doc_id"]][0] or ""
            words = [w.decode() for w in raw.encode().split()]
            lines, dup = set(), 0
            for line in raw.split("\n"):
                if line.encode().split():
                    dup += line in lines
                    lines.add(line)
            assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), dup)
            assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in raw)
            repeats = brute_repeats(words)
            assert r["n_repeat_words"] == repeats
            assert r["base_failed"] == (len(words) < 20 or 100 * repeats > 30 * len(words))
            assert not (r["base_failed"] and r["kept"])
            ids = [i for w in words for i in whole.encode(w)]
            assert r["n_tokens_1"] == len(ids)
            if ids:
                spans = [collections.Counter(ids[i : i + 64]) for i in range(0, len(ids), 64)]
                even = [(n := s.total()) * (-sum(c / n * math.log2(c / n) for c in s.values()) / math.log2(n) if n > 1 else 1.0) for s in spans]
                assert r["entropy_1"] == pytest.approx(sum(even) / len(ids)) and r["chars_per_token_1"] == pytest.approx(r["word_chars"] / len(ids))
                assert r["fallback_1"] == pytest.approx(sum(map(whole.is_byte, ids)) / len(ids))
    assert fertility.fertility(empty, MODELS).count() == 0 and fertility.keep(empty, MODELS).count() == 0
    assert fertility.keep(odd.withColumnRenamed("score", "_figures"), MODELS).columns == [*odd.columns[:-1], "_figures"]


def test_fertility_bands_reject_junk(spark):
    """On labelled texts: each kind of figure rejects, most low-quality texts go, hardly a good one does."""
    sf = "/root/testdata/sf0.01"
    found = fertility.fertility(spark.read.parquet(f"{sf}/documents.parquet"), MODELS).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    good, bad = found[found.quality == 1], found[found.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.3
    why = set(bad.outside.explode().dropna())
    assert {"entropy_1", "entropy_2"} <= why and any(w.startswith("chars_per_token") for w in why)


def test_words_encoded_alone_are_the_text(docs):
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor(model_file=MODELS[0])
    pieces = fertility.Pieces(MODELS)
    for (text,) in docs.select("text").limit(60).collect():
        rows, _, _, where = pieces.table.look_up([text.encode()])
        words = [w.decode() for w in where.words(range(len(rows)))]
        assert words == text.split() and pieces.table.values[1].take(rows).tolist() == whole.encode(" ".join(words))


def test_word_table_forgets_and_agrees():
    calls = []

    def compute(words):
        calls.append(len(words))
        return np.array([len(w) for w in words]), Ragged.of([[len(w)] * (len(w) % 3) for w in words])

    table, rng = WordTable(compute, room=50, lower_ascii=False, marks=b".,"), np.random.default_rng(4)
    for _ in range(30):
        texts = [b" ".join(b"w" * int(n) + (b"." if n % 2 else b"") for n in rng.integers(1, 200, 20)) for _ in range(3)] + [b"", b" \n"]
        rows, at, _, where = table.look_up(texts)
        words = where.words(range(len(rows)))
        assert words == [w.rstrip(b".") for t in texts for w in t.split()] and at.tolist() == [0, 20, 40, 60, 60, 60]
        assert table.values[0][rows].tolist() == [len(w) for w in words]
        assert table.values[1].take(rows).tolist() == [len(w) for w in words for _ in range(len(w) % 3)]
    assert max(calls) <= 60 and table.rows < 120


def test_toxicity_learns_gapped_words(spark, odd, empty):
    rng, rows = np.random.default_rng(3), []
    parts = ["lo", "mi", "ra", "tes", "un", "ka", "ver", "dol"]
    for i in range(600):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(40)]
        if i % 4 == 0:
            words[rng.integers(0, 40)] = rng.choice(["idiot", "moron", "stupid"])
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, model).collect()}
    held = [(scores[i], t) for i, _, t in rows if i % 3 == 0]
    assert all((s >= 0.7) == bool(t) for s, t in held)
    odd_ones = spark.createDataFrame([(1, "lomi you idi-ot ratesun"), (2, "lomi i d i o t ratesun"), (3, "lomi ratesun veruna")], "doc_id bigint, text string")
    gapped = {r["doc_id"]: r["score"] for r in toxicity.predict(odd_ones, model).collect()}
    assert min(gapped[1], gapped[2]) > 10 * gapped[3]
    assert toxicity.predict(odd, model).count() == len(ODD) and toxicity.predict(empty, model).count() == 0
    assert toxicity.fit(empty, labels) is None and toxicity.predict(odd, None).agg(F.max("score")).first()[0] == 0


def test_toxicity_learns_rare_insults(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 3)) for _ in range(40)]
        if i % 4 == 0:
            words[rng.integers(0, 40)] = "wretchedly" if i % 600 == 0 else "idiot"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    # wretchedly is in 5 of 750 toxic texts
    fresh = spark.createDataFrame([(1, "abc wretchedly bcd"), (2, "abc idiot bcd"), (3, "abc nop bcd")], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(fresh, model).collect()}
    assert min(scores[1], scores[2]) >= 0.7 > scores[3]


def test_toxicity_folds_near_copies(spark):
    shared = " ".join(f"w{k}" for k in range(200))
    rows = [(i, 10 + i, f"{shared} end{i}") for i in range(20)] + [(30, 50, "quite another text that stands alone")]
    toxic = spark.createDataFrame([r[1:] for r in rows], "around bigint, text string")
    assert {r["around"] for r in toxicity.folded(toxic).collect()} == {10, 50}


def test_language_held_out(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where("doc_id % 3 <> 1"))
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 3 = 1").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()
    found = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert found[2] == found[3] == found[4] == "und"
    assert langid.fit(empty) is None and langid.predict(empty, model).count() == 0


@pytest.mark.parametrize("sharding_of", [None, (15_000, 3)])
def test_language_model_against_brute_force(spark, docs, odd, empty, monkeypatch, sharding_of):
    """Whole, and with so small shards that runs are dealt in three steps."""
    if sharding_of:
        monkeypatch.setattr(ngram_lm, "SHARD_BYTES", sharding_of[0])
        monkeypatch.setattr(ngram_lm, "FAN", sharding_of[1])
    held = "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2"
    levels = ngram_lm.train(docs.where(f"not {held}"))
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [b"\0"]
    rows = docs.select("doc_id", "text").collect()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(w := tokens(t))
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = one.total(), len(one)
    assert (levels.tokens, levels.words, sum(levels.second), sum(levels.third)) == (n, v, len(two), len(three))
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, levels).collect()}
    for i, t in rows:
        w, base, full = tokens(t), 0.0, 0.0
        for k, x in enumerate(w):
            p = low = (one[x] + 1) / (n + v + 1)
            if k:
                p = (two[w[k - 1], x] + 20 * p) / (one[w[k - 1]] + 20)
            if k > 1:
                p = (three[w[k - 2], w[k - 1], x] + 20 * p) / (two[w[k - 2], w[k - 1]] + 20)
            base, full = base + math.log10(low), full + math.log10(p)
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(one[x] > 0 for x in w)
        assert got[i]["base_score"] == pytest.approx(base) and abs(got[i]["score"] - full) <= ngram_lm.STEP * len(w) + 1e-6
    assert ngram_lm.score(odd, levels).count() == len(ODD)
    assert ngram_lm.score(docs, ngram_lm.train(empty)).where("n_known > 0").count() == 0


def test_elias_fano_finds_all():
    rng = np.random.default_rng(5)
    for n, top in ((0, 10), (1, 2**40), (500, 600), (5000, 2**62), (3000, 3001)):
        values = np.unique(rng.integers(0, top, n).astype(np.uint64))
        ef = ngram_lm.EliasFano(ngram_lm.EliasFano.encode("x", values, top), "x")
        assert (ef.find(values) == np.arange(len(values))).all()
        other = np.setdiff1d(rng.integers(0, top, 1000).astype(np.uint64), values)
        assert (ef.find(other) == -1).all()
        if len(values):
            at = np.arange(len(values))
            assert (ef.access(at) == values).all()
            low, high = np.maximum(at - rng.integers(0, 9, len(at)), 0), np.minimum(at + 1 + rng.integers(0, 9, len(at)), len(at))
            assert (ef.within(values, low, high) == at).all() and (ef.within(values, low, at) == -1).all()


def test_nearest_recall_and_odd_vectors(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = ivfpq.nearest(vectors).toPandas()
    pdf = vectors.toPandas()
    x, ids = np.stack(pdf.embedding.values).astype(float), pdf.vec_id.to_numpy()
    hit = total = 0
    for q, g in rows.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert list(g.sort_values("rank")["rank"]) == list(range(1, 21))
        hit, total = hit + len({*best} & {*g.vec_id}), total + 20
    assert hit / total >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ivfpq.nearest(few).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 7, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 2.0), (20, 3, 2, 2.0), (20, 4, 7, 1.0)]
    assert ivfpq.nearest(few.limit(0)).count() == 0


def test_near_duplicates_against_brute_force(spark, docs, odd, empty):
    extra = spark.createDataFrame([(10_000 + i, " ".join(["w%d" % k for k in range(100)] + ["v%d" % i])) for i in range(40)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    config = lsh_forest.Forest(block=16, budget=20_000)  # groups of more than a block, and balls
    got = {r["doc_id"]: r for r in lsh_forest.near_duplicates(every, config).collect()}
    sets = {}
    for i, t in every.collect():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, links, parent = sorted(sets), collections.Counter(), {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: (got[i]["class_id"], got[i]["n_links"]) for i in ids} == {i: (find(i), links[i]) for i in ids}
    t = " ".join("w%d" % k for k in range(100))
    repeated = spark.createDataFrame([(1, t, "a"), (1, t, "b"), (2, t + " v2", "c"), (3, t + " v3", "d"), (7, "x y", "e"), (7, t, "f"), (None, t, "g"), (9, None, "h"), (9, None, "h")], "doc_id bigint, text string, _rank string")
    rows = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["n_copies"]) for r in lsh_forest.near_duplicates(repeated).collect())
    assert rows == [(0, 0, 0, 1), (1, 1, 4, 3), (1, 1, 4, 3), (2, 1, 4, 1), (3, 1, 4, 1), (7, 1, 4, 3), (7, 7, 0, 1), (9, 9, 0, 1), (9, 9, 0, 1)]
    kept = lsh_forest.keep_one(repeated)
    assert kept.columns == repeated.columns and sorted(r["_rank"] for r in kept.collect())[1:] == ["e", "g", "h", "h"]
    small = {r["doc_id"]: r for r in lsh_forest.near_duplicates(odd).collect()}
    assert small[1]["n_copies"] == 2 and small[2]["n_links"] == 0 and small[None]["class_id"] is None
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_trie_matches_what_all_pairs_connect():
    """matched() joins just what near signatures join, for nodes of like and of unlike members."""
    rng, config = np.random.default_rng(6), lsh_forest.Forest(trees=4, depth=6)
    for _ in range(30):
        base = rng.integers(0, 50, (3, 24)).astype(np.uint16)
        sig = base[rng.integers(0, 3, 40)].copy()
        sig[rng.random(sig.shape) < rng.random() * 0.4] = 7
        sig[:, :3] = 1  # one node: the shortest prefix is shared
        sig = sig[np.lexsort(sig[:, 5::-1].T)]
        least = 16
        found = lsh_forest.matched(sig[:, :6], sig, np.full(40, 3), 3, least)
        near = (sig[:, None, :] == sig[None, :, :]).sum(axis=2) >= least
        want = np.arange(40)
        for _ in range(40):
            want = np.where(near, want[None, :], 99).min(axis=1)
        assert len(np.unique(want)) == len(np.unique(found.root)) == 40 - len(found.links)
        assert all(len(np.unique(found.root[want == k])) == 1 for k in np.unique(want))
    assert config.shortest < config.depth


def test_own_depth_follows_what_a_text_can_have():
    config = lsh_forest.Forest()
    for n in range(1, 60):
        can = [i / (n + m - i) for m in range(1, 3 * n) for i in range(min(n, m) + 1) if not i == n == m and 5 * i >= 4 * (n + m - i)]
        assert lsh_forest.own_depth(n, config) == (config.depth_for(min(can)) if can else 0)


def test_components_of_a_path(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 200), (300, 300)], "a bigint, b bigint"))
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {i: 0 for i in range(51)} | {100: 100, 200: 100}


def test_components_of_hubs(spark):
    """Stars of more links than HUB_LINKS, round the smallest and round the largest node, and a bridge between them."""
    n = 3 * components.HUB_LINKS
    low, high = [(1, i) for i in range(2, n)], [(9 * n, i) for i in range(2 * n, 3 * n)]
    for bridge, roots in (([], {1, 2 * n}), ([(5, 2 * n + 7)], {1})):
        found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(low + high + bridge, "a bigint, b bigint")).collect()}
        assert len(found) == 2 * n and set(found.values()) == roots


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there friend, how are you?\nSecond line here of text."), (1, 1, "b", "On Monday, a wrote:\n> Hello there friend, how are you?\n> Second line here of text.\nI am fine thank you."),
        (1, 2, "c", "b wrote:\n>> Hello there   friend, how are you?\n> I am fine thank you.\n\nGood to know this."), (1, 3, "a", "> Good to know this.\nok"), (1, 4, "z", "> hello there friend, how are you?\nlate reply"),
        (2, 0, "a", None), (2, 1, "b", ""), (2, 1, "b", ""), (None, None, None, "> x"), (3, 0, "a", "> quotes nothing that is known\nown"),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert [by[1, k]["reply_to"] for k in range(5)] == [None, 0, 1, 2, 0]
    assert [by[1, k]["depth"] for k in range(5)] == [0, 1, 2, 3, 1]
    assert by[1, 1]["text"] == "I am fine thank you." and by[1, 2]["text"] == "Good to know this." and by[1, 2]["quote_depth"] == 2
    assert by[2, 0]["text"] == "" and by[3, 0]["reply_to"] is None and by[3, 0]["text"] == "own" and by[None, None]["text"] == ""
    assert [r["turn"] for r in got if r["conv_id"] == 1] == [0, 1, 2, 3, 4]
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_quotes_short_and_paragraphs(spark):
    rows = [
        (1, 0, "a", "Shall we do it?"), (1, 1, "b", "I agree."), (1, 2, "c", "> I agree.\nWhy though?"), (1, 3, "d", "ok\nthanks, all of you"), (1, 4, "e", "> ok\nwell"),
        (2, 0, "a", "The first paragraph is\nwrapped by hand here.\n\nThe second one is also\nwrapped by hand.\n\nThe third one is not quoted\nby anybody."),
        (2, 1, "b", "Something else in between."), (2, 2, "c", "> The first paragraph is wrapped\n> by hand here.\n>\n> The second one is\n> also wrapped by hand.\nRight."),
        (2, 3, "d", "> The third one\n> is not quoted by anybody.\nNow it is."), (3, 0, "a", "Yes\n> what\nno"), (3, 1, "b", "> Yes no\nfine"),
    ]
    got = quotes.reply_ordered(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    by = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread_root"]) for r in got}
    assert by[1, 2] == (1, 1) and by[1, 4] == (None, 4)
    assert by[2, 2] == (0, 0) and by[2, 3] == (0, 0) and by[3, 1] == (0, 0)


def test_word_hashes_follow_words():
    texts = [b"One two\tTHREE", b"", b" \n ", b"one " * 3000, b"y" * 5000, b"two one"]
    hashes, at = WordHasher()(texts)
    assert np.diff(at).tolist() == [3, 0, 0, 3000, 1, 2]
    assert hashes[0] == hashes[at[3]] == hashes[at[5] + 1] and hashes[1] == hashes[at[5]]


def test_quotes_against_brute_force(spark):
    """Random threads whose replies quote whole messages: origins, roots and the order of a walk through each tree."""
    rng, rows, up = np.random.default_rng(8), [], {}
    for conv in range(12):
        said = []
        for turn in range(int(rng.integers(1, 25))):
            own = " ".join(rng.choice(list("abcdefghij"), 12)) + f" {conv} {turn}"
            said.append(own)
            if turn and rng.random() < 0.8:
                up[conv, turn] = of = int(rng.integers(0, turn))
                rows.append((conv, turn, "x", f"> {said[of].upper()}\n{own}"))
            else:
                rows.append((conv, turn, "x", own))
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, lines string, text string")
    got = quotes.reply_ordered(messages).collect()

    def walk(conv, turn):
        yield conv, turn
        for t in sorted(t for (c, t), u in up.items() if c == conv and u == turn):
            yield from walk(conv, t)

    want = [x for c, t, *_ in rows if (c, t) not in up for x in walk(c, t)]
    assert [(r["conv_id"], r["turn"]) for r in got] == want
    assert all(r["reply_to"] == up.get((r["conv_id"], r["turn"])) and ">" not in r["text"] and r["lines"] == "x" for r in got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import compare

    compare.assert_same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], compare.database(SF))


CONTRACT = {
    "op1_hilbert_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op2_vector_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_fertility": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_elias_fano_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_langid": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_ivfpq": "query_id bigint, rank int, vec_id bigint, score double",
}


@pytest.fixture(scope="module")
def results(spark):
    return {name: queries.QUERIES[name](spark, SF).toPandas() for name in CONTRACT}


def test_contract_columns(spark, results):
    for name, ddl in CONTRACT.items():
        kinds = dict(queries.QUERIES[name](spark, SF).dtypes)
        assert all(kinds[c] == k for c, k in (x.split() for x in ddl.split(", "))), name
    for name in set(queries.QUERIES) - set(CONTRACT):
        assert queries.QUERIES[name](spark, SF).columns


def test_contract_values(results, docs):
    rows = {r["doc_id"]: r for r in docs.collect()}
    crc = lambda i: zlib.crc32(str(i).encode())
    for name, modulus, rest in (("op4_toxicity", 3, 1), ("op6_elias_fano_lm", 7, 2), ("op7_langid", 3, 1)):
        r = results[name]
        assert sorted(r.doc_id) == sorted(rows) and (r.held_out == [crc(i) % modulus == rest for i in r.doc_id]).all()
    one = results["op1_hilbert_shards"]
    raw = [(rows[i]["text"] or "").encode() for i in one.doc_id]
    assert (one["size"] == [len(t) + 1 for t in raw]).all() and (one.text_crc32 == [zlib.crc32(t) for t in raw]).all()
    assert set(one.law) == {"rows"} and set(one.shard) == set(range(8)) and one.grown_shard.isna().all()
    sizes = one.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in one.groupby("shard"))
    two, tokenizer = results["op2_vector_packing"], Tokenizer.from_file(WORD_BPE)
    for i, g in two.sort_values("start").groupby("doc_id"):
        ids = [*tokenizer.encode(rows[i]["text"] or "", add_special_tokens=False).ids, 1]
        assert (g.doc_tokens == len(ids)).all() and list(g.start) == [0, *g.length.cumsum()[:-1]] and g.length.sum() == len(ids)
        assert [zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()) for a, n in zip(g.start, g.length)] == list(g.ids_crc32)
    assert two.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in two.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]]
    four, seven = results["op4_toxicity"], results["op7_langid"]
    assert (four.predicted == (four.score >= 0.7)).all() and four.score.between(0, 1).all() and seven.score.between(0, 1).all()
    assert set(seven.lang_pred) <= {"en", "fr", "de", "es", "und"}
    six = results["op6_elias_fano_lm"]
    assert six.train_tokens.nunique() == 1 and (six.score > six.base_score).mean() > 0.9 and (six.n_known <= six.n_tokens).all()
    eight = results["op8_ivfpq"]
    assert (eight.groupby("query_id")["rank"].apply(list).map(lambda r: sorted(r) == list(range(1, 21)))).all()


def test_toxicity_held_out_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op4_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert found[found.toxic == 1].predicted.mean() >= 0.7 and found[found.toxic == 0].predicted.mean() <= 0.02


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_forget_removes_what_was_written(spark, docs):
    from strataflow.llm import common

    one, two = common.written(docs, "one"), common.written(docs.limit(3), "two")
    kept = common._PATHS[-1]
    common.forget(spark, [kept])
    assert common._PATHS == [kept] and two.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        one.count()


def test_pipeline_of_odd_rows(spark, odd, empty, tmp_path):
    """Null, empty, long, repeated rows and an extra column go through all stages; so does an empty table."""
    import corpus_pipeline

    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{docs is empty}"
            after = stage(spark, docs, SF)
            assert name == "packing" or after.columns == odd.columns
            after.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path) if name == "packing" else docs


def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator's own result, or SQL, says of its input."""
    import compare
    import corpus_pipeline

    sf, con = "/root/testdata/sf0.01", compare.database("/root/testdata/sf0.01")
    docs = seen = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda frame: sorted(r[0] for r in frame.select("doc_id").collect())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen, sf).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        con.sql("DROP VIEW IF EXISTS documents")
        table = seen.toPandas()
        con.register("documents", table)
        if k < 3:
            assert after.columns == docs.columns and 0 < after.count() < seen.count()
        if name == "quality_rules":
            assert ids(after) == ids(fertility.fertility(docs, MODELS).where("kept"))
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet").where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
            assert ids(after) == ids(toxicity.predict(seen, toxicity.fit(seen, labels)).where("score < 0.7"))
        if name == "near_duplicates":
            want = con.sql(f"SELECT DISTINCT class_id FROM ({queries.ORACLES['op9_lsh_forest']})").fetchall()
            assert ids(after) == sorted(r[0] for r in want)
        if name == "mixing":
            want = con.sql(f"SELECT doc_id FROM ({queries.ORACLES['op3_poisson_mix']})").fetchall()
            assert ids(after) == sorted(r[0] for r in want)
        if name == "packing":
            tokenizer, want = Tokenizer.from_file(WORD_BPE), collections.Counter()
            for i, t in seen.select("doc_id", "text").collect():
                want[i] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
            assert {r["doc_id"]: r["n"] for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
        seen = after
    assert seen.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
