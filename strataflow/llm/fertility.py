"""Tokeniser fertility: characters per token, byte-fallback share and token entropy of public vocabularies, with rejection
bands by language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import Ragged, WordTable, chunked, cut, fresh, held, paused_gc, small_batches, spread, sums, text_bytes, written

#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"


#: Tokens in a span whose entropy is taken; a text's figure is the mean over its tokens.
SPAN = 64


@dataclass(frozen=True)
class Rules:
    """Base rules as in `fertility`; how the bands follow from the figures of a language's texts, equal ones once: median -
    wide * spread to median + wide * spread, where the spread is the distance from the median to the lower and to the upper
    quartile, but at least `chars`, `fallback` or `entropy` by the figure's kind. A language with fewer than `enough` texts
    takes the band of all. Short texts' figures scatter: the band is wider by 1 + short / tokens."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    wide: float = 7.0
    chars: float = 0.03
    fallback: float = 0.01
    entropy: float = 0.004
    enough: int = 50
    short: int = 100

    def least(self, figure: str) -> float:
        return self.chars if figure.startswith("chars") else self.fallback if figure.startswith("fallback") else self.entropy


#: Code point ranges of scripts, Unicode blocks.
SCRIPTS = {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "cyrillic": [(0x400, 0x52F)], "cjk": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)]}
NAMES = [*SCRIPTS, "other", "none"]

COUNTS = [("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint")]


def measures(vocabularies: int) -> list[str]:
    """Names of the figures: of each vocabulary characters a token, share of byte tokens, mean entropy of its spans
    over the largest that a span of that length can have."""
    return [f"{m}_{v + 1}" for v in range(vocabularies) for m in ("chars_per_token", "fallback", "entropy")]


def script_of(word: str) -> int:
    """Index in NAMES of the script of a word's first letter."""
    for c in word:
        if c.isalpha():
            if c.isascii():
                return 0
            at = ord(c)
            return next((i for i, ranges in enumerate(SCRIPTS.values()) if any(a <= at <= b for a, b in ranges)), len(SCRIPTS))
    return len(SCRIPTS) + 1


class Vocabulary:
    """A public vocabulary: ids of words, and which ids stand for single bytes of what it has no piece for.

    A `.model` file is of sentencepiece with byte fallback; a `.tiktoken` file is a byte-level one, whose one-byte pieces
    over 127 are the fallback. A word is encoded alone: after a space, as within a text."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.is_byte = np.array([model.is_byte(i) or model.is_unknown(i) for i in range(model.vocab_size())])
            self.encode = lambda words: model.encode(words, num_threads=1)
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding("fertility", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
            self.is_byte[[i for b, i in ranks.items() if len(b) == 1 and b[0] > 127]] = True
            self.encode = lambda words: [coder.encode_ordinary(" " + w) for w in words]


class Pieces:
    """For words: the ids by each vocabulary and the script."""

    def __init__(self, paths: tuple[str, ...]):
        self.vocabularies = [Vocabulary(p) for p in paths]
        self.table = WordTable(self._compute, room=600_000, lower_ascii=False)

    def _compute(self, words: list[bytes]) -> tuple:
        texts = [w.decode("utf-8", "replace") for w in words]
        return (np.fromiter(map(script_of, texts), np.int8, len(texts)), *[Ragged.of(v.encode(texts)) for v in self.vocabularies])


def pieces(paths: tuple[str, ...]) -> Pieces:
    """One table for all tasks of a Python worker."""
    return held(("fertility", paths), lambda: Pieces(paths))


def repeat_words(hashes: np.ndarray, raw: bytes, window: int) -> int:
    """Words that lie in a window of words that the text holds twice or more."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for i in range(window):
        keys += hashes[i : i + n] * np.uint64(2 * i * 0x9E3779B97F4A7C15 % 2**64 | 1)
    ordered = np.sort(keys)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
    words, seen = raw.split(), {}
    spans = [tuple(words[i : i + window]) for i in twice.tolist()]  # equal hashes are looked at word by word
    for s in spans:
        seen[s] = seen.get(s, 0) + 1
    covered = np.zeros(len(hashes) + 1, np.int64)
    for i, s in zip(twice.tolist(), spans, strict=True):
        if seen[s] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def measured(texts: list[bytes], known: Pieces, window: int) -> list[np.ndarray]:
    """Of each text: COUNTS, the script's index, and of each vocabulary tokens and `measures` (NaN without tokens)."""
    rows, at, hashes, where = known.table.look_up(texts)
    n, data = len(texts), where.data
    starts_char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = sums(starts_char[where.starts + where.lengths] - starts_char[where.starts], at)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    n_symbols = symbols[np.minimum(where.texts[1:] - 1, len(data))] - symbols[where.texts[:-1]]
    dup = np.fromiter(map(duplicate_lines, texts), np.int64, n)
    repeat = np.array([repeat_words(hashes[a:z], t, window) for t, a, z in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
    n_words, text_of = np.diff(at), np.repeat(np.arange(n), np.diff(at))
    out = [n_words, chars, n_symbols, dup, repeat]
    if not len(rows):
        return [*out, np.full(n, len(NAMES) - 1), *[c for _ in known.vocabularies for c in (np.zeros(n, np.int64), *[np.full(n, np.nan)] * 3)]]
    votes = np.bincount(text_of * len(NAMES) + known.table.values[0][rows], minlength=n * len(NAMES)).reshape(n, -1)
    out.append(np.where(votes[:, :-1].any(axis=1), votes[:, :-1].argmax(axis=1), len(NAMES) - 1))
    for v, ids in zip(known.vocabularies, known.table.values[1:], strict=True):
        tokens = sums(ids.count[rows], at)
        taken = ids.take(rows)
        # entropy by spans of SPAN tokens, so that it doesn't hang on the text's length; a span never crosses texts
        spans = -(-tokens // SPAN)
        before = np.cumsum(spans) - spans
        position = spread(np.zeros(n, np.int64), tokens)
        span = np.repeat(before, tokens) + position // SPAN
        keys = np.sort(span * len(v.is_byte) + taken)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        many, own = np.diff(np.append(first, len(keys))), keys[first] // len(v.is_byte)
        size = np.bincount(span, minlength=int(spans.sum()))
        share = many / size[own]
        most = np.where(size > 1, np.log2(np.maximum(size, 2)), 1)
        even = np.where(size > 1, np.bincount(own, -share * np.log2(share), len(size)) / most, 1.0)
        entropy = np.bincount(np.repeat(np.arange(n), spans), even * size, n)
        some = tokens > 0
        of = lambda x, some=some, tokens=tokens: np.where(some, x / np.maximum(tokens, 1), np.nan)
        token_at = np.concatenate(([0], np.cumsum(tokens)))
        out += [tokens, of(chars), of(sums(v.is_byte[taken], token_at)), of(entropy)]
    return out


def figures(docs: DataFrame, models: tuple[str, ...], rules: Rules) -> tuple[DataFrame, str]:
    """docs with a column of the figures of each row's text, and its name. One pass, no shuffle; rows stay as they are."""
    (name,) = fresh(docs, "_figures")
    names, at = measures(len(models)), docs.columns.index("text")
    kinds = [*COUNTS, ("script", "string"), *[f for v in range(len(models)) for f in ((f"n_tokens_{v + 1}", "bigint"), *[(m, "double") for m in names[3 * v : 3 * v + 3]])]]
    schema = docs.select("*", F.lit(None).cast("struct<" + ",".join(f"{n}:{k}" for n, k in kinds) + ">").alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(models)
        with paused_gc():
            for b in batches:
                texts = [text_bytes(t) for t in b.column(at).to_pylist()]
                parts = [measured(run, known, rules.window) for _, run in chunked(texts)]
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0)] * len(kinds)
                arrays = [pa.array(np.array(NAMES, object)[c.astype(int)], pa.string()) if n == "script" else pa.array(c.astype(np.int64)) if k == "bigint" else pa.array(c.astype(np.float64), from_pandas=True) for c, (n, k) in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(arrays, names=[n for n, _ in kinds])], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema), name


def failed(f: str, rules: Rules) -> Column:
    """The base rules, on the column of figures."""
    return (F.col(f"{f}.n_words") < rules.min_words) | (100 * F.col(f"{f}.n_repeat_words") > rules.max_repeat_percent * F.col(f"{f}.n_words"))


def judged(docs: DataFrame, models: tuple[str, ...], rules: Rules, *drop: str) -> tuple[DataFrame, str, str, str]:
    """docs (but columns `drop`) with figures, an array of the names of the figures that lie outside their band, and the
    verdict; their names. Figures are written with the rows once; bands, one row a language, are joined by broadcast."""
    small_batches(docs.sparkSession)
    rows, f = figures(docs, models, rules)
    seen = written(rows.drop(*drop), "fertility")
    by_script = F.col(f"{f}.script")
    group, names = F.coalesce(F.col("lang").cast("string"), by_script) if "lang" in docs.columns else by_script, measures(len(models))
    sound = seen.where(~failed(f, rules)).select(group.alias("g"), f"{f}.*").distinct()
    of = [F.count(F.lit(1)).alias("n"), *[F.percentile_approx(m, [0.25, 0.5, 0.75], 2000).alias(m) for m in names]]

    def ends(m: str) -> Column:
        q, least = F.col(m), F.lit(rules.least(m))
        return F.struct((q[1] - rules.wide * F.greatest(q[1] - q[0], least)).alias("low"), (q[1] + rules.wide * F.greatest(q[2] - q[1], least)).alias("high"), q[1].alias("mid"))

    band, g, whole = fresh(seen, "_band", "_group", "_whole")
    bands = cut(sound.groupBy("g").agg(*of).where(F.col("n") >= rules.enough).select(F.col("g").alias(g), F.struct(*[ends(m).alias(m) for m in names]).alias(band)))
    every = cut(sound.agg(*of).select(F.struct(*[ends(m).alias(m) for m in names]).alias(whole)))  # one row
    joined = seen.withColumn(g, group).join(F.broadcast(bands), g, "left").join(F.broadcast(every)).withColumn(band, F.coalesce(band, whole))
    out, kept = fresh(joined, "_outside", "_kept")

    def beyond(m: str) -> Column:
        x, b, wider = F.col(f"{f}.{m}"), F.col(band)[m], 1 + rules.short / F.greatest(F.col(f"{f}.n_tokens_{m.rpartition('_')[2]}"), F.lit(1))
        return F.when((x < b["mid"] - (b["mid"] - b["low"]) * wider) | (x > b["mid"] + (b["high"] - b["mid"]) * wider), F.lit(m))

    verdict = ~failed(f, rules) & (F.size(out) == 0) & (by_script != "none")
    return joined.withColumn(out, F.array_compact(F.array(*map(beyond, names)))).withColumn(kept, F.coalesce(verdict, F.lit(False))).drop(g, band, whole), f, out, kept


def fertility(docs: DataFrame, models: tuple[str, ...], rules: Rules = Rules()) -> DataFrame:
    """doc_id, word, line and symbol counts of each whole text, its fertility by each vocabulary, what lies outside its
    band, and whether it is kept.

    A text is kept if it has min_words words, at most max_repeat_percent of them in windows of `window` words that come
    twice or more, and each figure of each vocabulary lies in the band of its language (`lang`; its script if that is
    null). Bands come from all texts that pass the base rules, by language (see Rules): texts are encoded in one pass, and
    what follows reads figures only. models: paths of public vocabularies, `.model` of sentencepiece or `.tiktoken`.

    Null or empty text, or only white space: counts 0, script none, measures null, base_failed true, kept false. Texts of
    words without a letter: script none, not kept. Very long text: whole. Null doc_id: kept as null. Repeated rows: a row
    each. Ties of scripts: the first in SCRIPTS. Empty table: no rows. Other columns, whatever their names, are not read.
    """
    columns = [docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), *([docs["lang"]] if "lang" in docs.columns else [])]
    rows, f, out, kept = judged(docs.select(*columns), models, rules, "text")
    names = [n for n, _ in COUNTS] + ["script"] + [n for v in range(len(models)) for n in (f"n_tokens_{v + 1}", *measures(len(models))[3 * v : 3 * v + 3])]
    return rows.select("doc_id", *[F.col(f"{f}.{n}").alias(n) for n in names], failed(f, rules).alias("base_failed"), F.col(out).alias("outside"), F.col(kept).alias("kept"))


def keep(docs: DataFrame, models: tuple[str, ...], rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that `fertility` keeps, in all their columns, whatever their names. Odd rows as there; a docs
    without `lang` is judged by script. The rows with their figures are written once, so that texts are encoded once."""
    rows, _, _, kept = judged(docs, models, rules)
    return rows.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])
