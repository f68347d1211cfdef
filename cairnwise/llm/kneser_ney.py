"""Quality by perplexity under an interpolated modified Kneser-Ney model.

The model is a character n-gram model per language, trained on all trusted
texts. Character n-grams are counted by Spark; continuation counts, discounts
and interpolated probabilities are joins and aggregates of the count tables,
order by order. The finished table (n-gram: log probability, context: log
back-off weight) is cut into shards by language and last context symbol. Spark
writes each as one sorted file in the shared folder; the tasks that score the
documents read the shards' files in turn, and a document's partial sums are
added up. No part of the model passes the driver. Texts are shuffled only once,
where trusted ids meet them.

Each language has its own threshold, derived from quantiles of the trusted
texts' log perplexities out of sample: the trusted texts are halved, and each
half is scored by a model of the other one. A language of few trusted texts has
its own median, and takes the distance from it over from all languages. An n-gram does not see that a text
says one word over and over, so words equal to the one before are counted too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnwise.llm.token_files import _filesystem
from cairnwise.llm.wordwise import slices, words_of
from cairnwise.session import materialise, scratch_path

ORDER = 5
SYMBOL_BITS = 12
#: Bytes of text that a worker counts at once.
SLICE = 3 << 20
#: Bytes of text that a worker scores at once, beside a shard of the model; a symbol takes about a dozen numbers.
SCORE_SLICE = 1 << 20
#: Code points below this are one symbol; others are two, the upper bits and the lower TRAIL bits, so that no two collide.
OWN = 1983
TRAIL = 10
#: Entries that one shard of the model holds at most (a single symbol's entries stay together).
SHARD_ENTRIES = 6_000_000
#: A document is rejected if its log perplexity exceeds the trusted median (out of sample) by more than SPREAD times
#: the distance between these two quantiles; a text of n symbols is given sqrt(1 + SHORT / n) times that, and the
#: upper quantile is of distances divided by it.
QUANTILES = (0.5, 0.99)
SPREAD = 1.25
SHORT = 100
#: A document is rejected as well if the share of its words that equal the word before exceeds the larger of
#: ECHO and twice the trusted upper quantile; short texts are given the same leeway.
ECHO = 0.2
#: Distinct trusted texts that a language needs for a quantile of its own; below, the one over all languages' texts counts.
LEAST = 30
#: The median of so few texts is uncertain, and their model thin: with t texts the distance is sqrt(1 + THIN / t) times that.
THIN = 10
_MASK = (1 << SYMBOL_BITS) - 1
_SCORES = "doc_id bigint, version bigint, lang string, total double, symbols bigint, n bigint, echo double"


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols 1..4095 of all texts, joined, and the number of each text's symbols."""
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    wide = raw >= OWN
    if not wide.any():
        return 1 + raw, sizes
    at = np.cumsum(1 + wide) - 1  # place of a code point's last symbol
    codes = np.empty(at[-1] + 1, np.int64)
    codes[at] = np.where(wide, _MASK - (1 << TRAIL) + 1 + (raw & ((1 << TRAIL) - 1)), 1 + raw)
    codes[at[wide] - 1] = 1 + OWN + (raw[wide] >> TRAIL)
    more = np.concatenate([[0], np.cumsum(wide)])
    ends = np.cumsum(sizes)
    return codes, sizes + more[ends] - more[ends - sizes]


def ngram_keys(codes: np.ndarray, sizes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at every symbol; 0 stands before a text's start."""
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = codes.copy()
    for k in range(1, order):
        back = np.zeros(len(codes), np.int64)
        back[k:] = codes[:-k] if k < len(codes) else 0
        key |= np.where(place >= k, back, 0) << (SYMBOL_BITS * k)
    return key


def _written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once with zstandard to the shared folder and read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    coded = batch.column("lang").dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        rows = np.flatnonzero(index == i)
        yield lang, rows, batch.column("text").take(pa.array(rows))


def count_ngrams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, key, n``: counts of the n-grams of this order over all rows (``text, lang``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            for lang, _, texts in _by_language(batch):
                keys, n = np.unique(ngram_keys(*symbols(texts), order), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"]
                )

    counted = rows.select("text", "lang").mapInArrow(run, "lang string, key bigint, n bigint")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Modified Kneser-Ney discounts of each language from the counts of counts.

    Where these are degenerate (tiny training sets) 0.5, 1 and 1.5 are used.
    """
    few = [F.sum((F.col("n") == k).cast("bigint")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    out = {}
    for r in counts.groupBy("lang").agg(*few).collect():
        n1, n2, n3, n4 = (r[f"n{k}"] for k in (1, 2, 3, 4))
        ds = (0.5, 1.0, 1.5)
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            ds = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            if not all(0 < d < k for k, d in enumerate(ds, 1)):
                ds = (0.5, 1.0, 1.5)
        out[r["lang"]] = ds
    return out


def kneser_ney_model(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, order, key, logp, back`` from trusted ``text, lang``.

    ``logp`` is the natural logarithm of the interpolated probability of the
    n-gram's last symbol after its others (null for contexts at a text's start,
    which are no n-grams themselves); ``back`` that of the back-off weight of
    the n-gram as a context (null where it never is one). The entry of order 0
    holds the back-off weight of the empty context, and the log of the uniform
    probability over the language's symbols and one unknown.
    """
    return _model_of_counts(_written(count_ngrams(rows, order), "counts"), order)


def _model_of_counts(longest: DataFrame, order: int) -> DataFrame:
    """The model from the counts of the longest n-grams."""
    spark = longest.sparkSession
    counts = {order: longest}
    for n in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << (SYMBOL_BITS * n)) - 1))
        counts[n] = _written(counts[n + 1].groupBy("lang", suffix.alias("key")).agg(F.count(F.lit(1)).alias("n")), "counts")
    unit = counts[1].groupBy("lang").agg((-F.log(F.count(F.lit(1)) + F.lit(1.0))).alias("logp"))
    lower = unit.select("lang", F.lit(0).cast("bigint").alias("key"), "logp")
    tables, previous = [], None
    for n in range(1, order + 1):
        found = discounts(counts[n])
        table = spark.createDataFrame(
            [(lang, *map(float, ds)) for lang, ds in found.items()], "lang string, d1 double, d2 double, d3 double"
        )
        own = counts[n].join(F.broadcast(table), "lang")
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.select("lang", "key", "n", cut.alias("cut"), F.shiftright("key", SYMBOL_BITS).alias("context"))
        contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("gamma"))
        suffix = F.col("key").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (n - 1))) - 1))
        below = lower.select("lang", F.col("key").alias("suffix"), F.col("logp").alias("below"))
        made = (
            own.join(contexts, ["lang", "context"])
            .withColumn("suffix", suffix)
            .join(below, ["lang", "suffix"])
            .select(
                "lang",
                "key",
                F.log((F.col("n") - F.col("cut")) / F.col("total") + F.col("gamma") * F.exp("below")).alias("logp"),
            )
        )
        backs = contexts.select("lang", F.col("context").alias("key"), F.log("gamma").alias("back"))
        tables.append(lower.join(backs, ["lang", "key"], "full").select("lang", F.lit(n - 1).alias("order"), "key", "logp", "back"))
        lower = _written(made, "probabilities")
    last = lower.select("lang", F.lit(order).alias("order"), "key", "logp", F.lit(None).cast("double").alias("back"))
    model = last
    for t in tables:
        model = model.unionByName(t)
    return _written(model, "model")


def shard_plan(model: DataFrame, entries: int = SHARD_ENTRIES) -> list[list[tuple[str, int]]]:
    """Groups of (language, last context symbol) whose entries fit into one shard.

    An entry serves n-grams whose last context symbol is the second to last one
    of an n-gram, and the last one of a context; entries of order 0 and 1 go along
    with every shard of their language. The plan has at most languages x symbols rows.
    """
    sizes = model.where("order > 1").groupBy("lang", _link(-1).alias("link")).count()
    more = model.where("order > 0 and back is not null").groupBy("lang", _link(0).alias("link")).count()
    rows = sizes.unionByName(more).groupBy("lang", "link").agg(F.sum("count").alias("n")).orderBy("lang", "link").collect()
    shards, held = [[]], 0
    for r in rows:
        if shards[-1] and held + r["n"] > entries:
            shards.append([])
            held = 0
        shards[-1].append((r["lang"], r["link"]))
        held += r["n"]
    return shards


def _link(position: int):
    return F.shiftright(F.col("key"), SYMBOL_BITS if position else 0).bitwiseAND(F.lit(_MASK))


def echoes(texts: pa.Array) -> np.ndarray:
    """The share of each text's words, split at white space, that equal the word before."""
    _, index, counts = words_of(texts, pc.utf8_split_whitespace)
    doc = np.repeat(np.arange(len(counts)), counts)
    again = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=len(counts)) / np.maximum(counts, 1)


class Shard:
    """A part of the model as sorted arrays by language and order.

    ``entries`` are sorted by language, order and key. ``links`` are the context
    symbols that the shard answers for; the first shard also answers for all that
    are in no shard (``elsewhere`` then has the others').
    """

    def __init__(self, links: list[tuple[str, int]], entries: pa.Table, elsewhere: list[tuple[str, int]] | None):
        self.tables, self.links = {}, {}
        coded = entries.column("lang").combine_chunks().dictionary_encode()
        names, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        orders, *columns = (entries.column(c).to_numpy() for c in ("order", "key", "logp", "back"))
        edges = np.flatnonzero((np.diff(index) != 0) | (np.diff(orders) != 0)) + 1
        starts = np.concatenate([[0], edges]) if len(index) else []
        for a, b in zip(starts, [*edges, len(index)]):
            lang = names[index[a]]
            self.tables[lang, int(orders[a])] = tuple(c[a:b] for c in columns)
            self.links.setdefault(lang, np.full(_MASK + 1, elsewhere is not None))
        for lang, link in elsewhere or []:
            self.links[lang][link] = False
        for lang, link in links:
            self.links[lang][link] = True

    def score(self, lang: str, keys: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of the n-grams, by backing off from the longest order."""
        out, offset = np.zeros(len(keys)), np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(order, 0, -1):
            own = keys[left] & ((1 << (SYMBOL_BITS * n)) - 1)
            hit, logp = self._find(lang, n, own, 1)
            hit &= ~np.isnan(logp)
            out[left[hit]] = offset[left[hit]] + logp[hit]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            known, back = self._find(lang, n - 1, own >> SYMBOL_BITS, 2)
            offset[left] += np.where(known & ~np.isnan(back), back, 0.0)
        out[left] = offset[left] + self.tables[lang, 0][1][0]
        return out

    def _find(self, lang: str, order: int, keys: np.ndarray, column: int) -> tuple[np.ndarray, np.ndarray]:
        table = self.tables.get((lang, order))
        if table is None or not len(table[0]):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return table[0][at] == keys, table[column][at]


def write_shards(model: DataFrame, plan: list[list[tuple[str, int]]]) -> str:
    """Writes one sorted file for each shard of the plan; returns their folder.

    An entry goes to at most two shards. Entries of order 0 and 1 go along with
    every shard of their language, and all of them with the first one.
    """
    spark = model.sparkSession
    dealt = [(lang, link, number) for number, links in enumerate(plan) for lang, link in links]
    dealt = F.broadcast(spark.createDataFrame(dealt, "lang string, link bigint, shard int"))
    held = dealt.groupBy("lang").agg(F.collect_set("shard").alias("shards"))
    shard_of = lambda name: dealt.withColumnRenamed("shard", name)
    far = model.where("order > 1").withColumn("link", _link(-1)).join(shard_of("one"), ["lang", "link"], "left")
    near = F.when(F.col("back").isNotNull(), _link(0))
    far = far.withColumn("link", near).join(shard_of("two"), ["lang", "link"], "left")
    far = far.withColumn("shards", F.array_distinct(F.array_compact(F.array("one", "two"))))
    low = model.where("order <= 1").join(F.broadcast(held), "lang", "left")
    low = low.withColumn("shards", F.array_union(F.array(F.lit(0)), F.coalesce("shards", F.array().cast("array<int>"))))
    columns = [F.explode("shards").alias("shard"), "lang", "order", "key", "logp", "back"]
    path = scratch_path(spark, "shards")
    routed = far.select(*columns).unionByName(low.select(*columns)).repartition(len(plan), "shard")
    routed.sortWithinPartitions("shard", "lang", "order", "key").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return path


def _read_shard(path: str, number: int) -> pa.Table:
    files, inside = _filesystem(f"{path}/shard={number}")
    found = [f.path for f in files.get_file_info(fs.FileSelector(inside)) if f.path.endswith(".parquet")]
    columns = ["lang", "order", "key", "logp", "back"]
    tables = [pq.read_table(files.open_input_file(f), columns=columns) for f in found]
    if len(tables) != 1:
        raise ValueError(f"{len(tables)} files of shard {number} in {path}")
    return tables[0]


def log_probabilities(docs: DataFrame, model: DataFrame, order: int = ORDER, entries: int = SHARD_ENTRIES) -> DataFrame:
    """``doc_id, version, lang, total, symbols, n, echo``: the log probability of each text of ``docs``.

    ``docs`` has ``doc_id, version, text, lang``; ``n`` is the number of rows that
    share the first three, whose totals and symbols are added up; ``echo`` see ``echoes``. One pass over
    the documents per shard. Languages without a model give no rows.
    """
    spark = docs.sparkSession
    plan = [links for links in shard_plan(model, entries) if links]
    if not plan:
        return spark.createDataFrame([], _SCORES)
    path, passes = write_shards(model, plan), None
    for number, links in enumerate(plan):
        elsewhere = [x for other in plan[1:] for x in other] if number == 0 else None

        def run(batches: Iterator[pa.RecordBatch], number=number, links=links, elsewhere=elsewhere) -> Iterator[pa.RecordBatch]:
            own = Shard(links, _read_shard(path, number), elsewhere)
            for batch in slices(batches, "text", SCORE_SLICE):
                for lang, rows, texts in _by_language(batch):
                    if (lang, 0) not in own.tables:
                        continue
                    codes, sizes = symbols(texts)
                    keys = ngram_keys(codes, sizes, order)
                    mine = np.flatnonzero(own.links[lang][keys >> SYMBOL_BITS & _MASK])
                    doc = np.repeat(np.arange(len(sizes)), sizes)[mine]
                    total = np.bincount(doc, weights=own.score(lang, keys[mine], order), minlength=len(sizes))
                    count = np.bincount(doc, minlength=len(sizes))
                    taken = pa.array(rows)
                    columns = [
                        batch.column("doc_id").take(taken),
                        batch.column("version").take(taken),
                        pa.array([lang] * len(rows), pa.string()),
                        pa.array(total),
                        pa.array(count),
                        pa.array(np.full(len(rows), int(number == 0))),
                        pa.array(echoes(texts) if number == 0 else np.zeros(len(rows))),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "version", "lang", "total", "symbols", "n", "echo"])

        scored = docs.select("doc_id", "version", "text", "lang").mapInArrow(run, _SCORES)
        passes = scored if passes is None else passes.unionByName(scored)
    sums = [F.sum(c).alias(c) for c in ("total", "symbols", "n")]
    return passes.groupBy("doc_id", "version", "lang").agg(*sums, F.max("echo").alias("echo"))


def _halved(rows: DataFrame) -> DataFrame:
    """``doc_id, version, text, lang, half``, written once; equal texts are in one half."""
    made = rows.select("doc_id", "version", "text", "lang", F.pmod("version", F.lit(2)).cast("int").alias("half"))
    return _written(made, "trusted")


def _symbols_of(text: str):
    """The number of symbols of a text, as in ``symbols``."""
    wide = F.length(F.regexp_replace(text, f"[\\x{{0}}-\\x{{{OWN - 1:x}}}]", ""))
    return (F.length(text) + wide).cast("bigint")


def _leeway(symbols):
    """How much further from the median a text of so many symbols may be than a long one."""
    return F.sqrt(1 + SHORT / F.greatest(symbols, F.lit(1)))


def _with_halves(learnt: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The models of all trusted texts and of their halves, whose languages begin with 0 or 1.

    The halves' counts add up to all counts; the three models are made in one go.
    """
    halves = _written(count_ngrams(learnt.select("text", F.concat("half", "lang").alias("lang")), order), "counts")
    whole = halves.groupBy(F.concat(F.lit("2"), F.expr("substring(lang, 2)")).alias("lang"), "key").agg(F.sum("n").alias("n"))
    model = _model_of_counts(halves.unionByName(_written(whole, "counts")), order)
    is_whole = F.col("lang").startswith("2")
    return model.where(is_whole).withColumn("lang", F.expr("substring(lang, 2)")), model.where(~is_whole)


def document_quality(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """One row per input row: ``doc_id, lang, symbols, perplexity, limit, kept``.

    ``trusted`` holds the ids (first column) of the texts that the model is
    trained on. ``perplexity`` is per symbol; ``limit`` is the language's, see
    QUANTILES and SPREAD; texts that repeat single words are rejected too, see ECHO. A null text counts as empty; a text without symbols, or in a
    language without trusted text, has no perplexity and is kept; a language with fewer
    than LEAST distinct trusted texts takes the distance of its limit from all languages' texts, one
    whose trusted texts are all in one half has no limit and is kept; a null language
    is a language of its own, returned as null. Null ids are never trusted;
    repeated rows repeat their result. Other columns are not read.
    """
    return _document_quality(docs, trusted, id_col, text_col, lang_col, order, entries).drop("version")


def _document_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str, order: int = ORDER, entries: int = SHARD_ENTRIES
) -> DataFrame:
    """The columns of ``document_quality``, and the ``version`` (hash) of the text."""
    rows = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
    ).withColumn("version", F.xxhash64("text"))
    ids = trusted.select(F.col(trusted.columns[0]).cast("bigint").alias("doc_id")).distinct()
    # trusted ids grow with the documents, so they are never broadcast, small as they may be
    learnt = _halved(rows.join(ids.hint("merge"), "doc_id", "left_semi").where("text <> ''"))
    model, halves = _with_halves(learnt, order)
    scored = materialise(
        log_probabilities(rows, model, order, entries).withColumn(
            "loss", F.when(F.col("symbols") > 0, -F.col("total") / F.col("symbols"))
        ),
        "perplexities",
    )
    # each half by the model of the other; copies of a text are in one half and count once
    other = learnt.select("doc_id", "version", "text", F.concat(F.lit(1) - F.col("half"), "lang").alias("lang"))
    # one half after the other, so that the driver never holds both models
    apart = [F.col("lang").startswith(h) for h in "01"]
    known = reduce(DataFrame.unionByName, [log_probabilities(other.where(h), halves.where(h), order, entries) for h in apart])
    known = known.select(
        F.expr("substring(lang, 2)").alias("lang"),
        "version",
        (-F.col("total") / F.col("symbols")).alias("loss"),
        _leeway(F.col("symbols") / F.col("n")).alias("leeway"),
        "echo",
    )
    one = [F.min(c).alias(c) for c in ("loss", "leeway", "echo")]
    known = materialise(known.groupBy("lang", "version").agg(*one), "losses")
    quantile = lambda value, q: F.percentile_approx(value, F.lit(q), F.lit(10_000))
    middles = known.groupBy("lang").agg(quantile(F.col("loss"), QUANTILES[0]).alias("middle"), F.count(F.lit(1)).alias("texts"))
    above = (F.col("loss") - F.col("middle")) / F.col("leeway")
    far = [quantile(above, QUANTILES[1]).alias("far"), quantile(F.col("echo") / F.col("leeway"), QUANTILES[1]).alias("often")]
    placed = known.join(F.broadcast(middles), "lang")
    everywhere = placed.agg(*far).first()  # two numbers
    of = lambda c: F.when(F.col("texts") >= LEAST, F.col(c)).otherwise(F.lit(everywhere[c]).cast("double"))
    unsure = F.when(F.col("texts") >= LEAST, 1.0).otherwise(F.sqrt(1 + THIN / F.col("texts")))
    most = F.greatest(F.lit(ECHO), 2 * of("often")).alias("most")
    cuts = placed.groupBy("lang", "middle", "texts").agg(*far).select("lang", "middle", (SPREAD * unsure * of("far")).alias("room"), most)
    leeway = _leeway(F.col("symbols") / F.col("n"))
    room, echoing = F.col("room") * leeway, F.coalesce(F.col("echo") > F.col("most") * leeway, F.lit(False))
    judged = scored.join(F.broadcast(cuts), "lang", "left").withColumn("cut", F.col("middle") + room).select(
        "doc_id", "lang", "version", "symbols", "n", F.exp("loss").alias("perplexity"), F.exp("cut").alias("limit"),
        (F.coalesce(F.col("loss") <= F.col("cut"), F.lit(True)) & ~echoing).alias("kept"),
    )
    judged = judged.withColumn("n", F.explode(F.array_repeat("n", F.col("n").cast("int"))))
    languages = model.where("order = 0").select("lang")
    unknown = rows.join(F.broadcast(languages), "lang", "left_anti").select(
        "doc_id", "lang", "version", _symbols_of("text").alias("symbols"), F.lit(None).cast("double").alias("perplexity"),
        F.lit(None).cast("double").alias("limit"), F.lit(True).alias("kept"),
    )
    return (
        judged.withColumn("symbols", (F.col("symbols") / F.col("n")).cast("bigint"))
        .select(unknown.columns)
        .unionByName(unknown)
        .withColumn("lang", F.when(F.col("lang") != "", F.col("lang")))
    )


def drop_low_quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """``docs`` with its own columns, without the rejected documents.

    Decisions are joined on id, text and language, so a rejected text takes no
    other one along that shares its id or has none either.
    """
    key = ["__id", "__null", "__version", "__lang"]

    def keys(id_, version, lang) -> list:
        known = F.coalesce(id_, F.lit(0)).alias("__id"), id_.isNull().alias("__null")
        return [*known, version.alias("__version"), F.coalesce(lang, F.lit("")).alias("__lang")]

    bad = _document_quality(docs, trusted, id_col, text_col, lang_col, **options).where("not kept")
    bad = bad.select(*keys(F.col("doc_id"), F.col("version"), F.col("lang"))).distinct()
    version = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    own = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__own"),
        *keys(docs[id_col].cast("bigint"), version, docs[lang_col].cast("string")),
    )
    return own.join(bad, key, "left_anti").select("__own.*")
