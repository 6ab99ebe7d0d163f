"""Language of code-switched text: a conditional random field labels the words, its marginals decide the document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import query, table
from tickloom.llm.crf import Tagger, fit, folded, slices

SAMPLE_TEXTS = 500  # for each language
SAMPLE_CHARS = 8_000  # of one text in the sample
PARTS = 4  # stretches of a longer text
MAX_LANGUAGES = 200
OUT = "doc_id long, tag long, lang_pred string, score double, segments array<struct<start:int,end:int,lang:string>>"


def held_out(folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1)) == fold


def stretches(text: Column, chars: int) -> Column:
    """The text, or of a longer one about `chars` characters: a stretch of each quarter, placed by a hash of the text."""
    size, part = F.floor(F.length(text) / PARTS).cast("int"), max(1, chars // PARTS)
    at = [F.lit(i) * size + 1 + F.pmod(F.xxhash64(text, F.lit(i)), F.greatest(size - part + 1, F.lit(1))).cast("int") for i in range(PARTS)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *(F.substr(text, a, F.lit(part)) for a in at)))


def learn(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> tuple[Tagger, list[str]]:
    """A field over the languages of `docs` (text, lang), fitted on at most about `texts` documents of each.

    Every word of a sampled text carries the text's language. The sample is drawn by a hash of the text, evenly over languages; equal
    texts of a language count once, and of a text above `chars` characters stretches are taken. That bounds what reaches the
    driver: texts * chars * languages.
    """
    rows = docs.select("text", "lang", F.xxhash64("text", F.lit("draw")).alias("h")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    distinct = rows.select("lang", "h").distinct()
    counts = dict(distinct.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages; raise MAX_LANGUAGES if that is meant.")
    names = sorted(counts)
    if not names:
        return Tagger(np.zeros((1 << 18, 1)), np.zeros(1), np.zeros((1, 1))), []
    # in the order of the draw, as far into it as the language has a share; a language's few texts all count
    share = F.create_map(*[F.lit(x) for name in names for x in (name, min(1.0, texts / counts[name]))])
    turn = (F.pmod("h", F.lit(1_000_000)) / 1e6) / share[F.col("lang")]
    drawn = distinct.withColumn("turn", turn).where("turn < 1").orderBy("turn", "lang", "h").limit(2 * texts * len(names))
    first_letter = F.length(F.regexp_extract("text", r"^\P{L}*", 0)) + 1
    part = stretches(F.col("text"), chars)
    part = F.when(part.rlike(r"\p{L}"), part).otherwise(F.substr("text", first_letter, F.lit(chars)))
    # the draw is bounded, so the texts are not moved to find it
    found = rows.join(F.broadcast(drawn.select("lang", "h")), ["lang", "h"])
    got = found.select("lang", "h", part.alias("text")).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: (r["lang"], r["text"]))
    label = {name: i for i, name in enumerate(names)}
    sizes = [len(r["text"].encode().split()) for r in got]
    gold = [np.full(n, label[r["lang"]]) for n, r in zip(sizes, got)]
    return fit([r["text"] for r in got], gold, len(names)), names


def identify(docs: DataFrame, tagger: Tagger, names: list[str]) -> DataFrame:
    """(doc_id, tag, lang_pred, score, segments) for every row of `docs` (doc_id, text; other columns are ignored).

    lang_pred is the language with the largest mean marginal over the words that have letters or digits, ties to the first by
    name; score is that mean. segments are runs of words (from 0) by their likeliest language. Texts that are null, empty or without letters
    are `und` with score 0 and no segments, and so is every text if nothing was learned. Rows with one id are told apart by
    `tag`, a hash of the text. An empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tagger.weights.astype(np.float32), tagger.start, tagger.trans))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start, trans = shared.value
        model = Tagger(weights, start, trans)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = folded(part.column("text"))
                chance, known = model.marginals(words)
                owner = words.owner()
                n = np.bincount(owner, known, minlength=b - a)
                mean = np.stack([np.bincount(owner, chance[:, j] * known, minlength=b - a) for j in range(len(start))], axis=1).astype(float)
                mean /= np.maximum(n, 1)[:, None]
                best = mean.argmax(axis=1)
                ok = np.asarray(part.column("letters").fill_null(False).to_numpy(zero_copy_only=False), bool) & (n > 0) & bool(names)
                likely = chance.argmax(axis=1) if len(chance) else np.zeros(0, np.int64)
                new = np.ones(len(likely), bool)
                new[1:] = (likely[1:] != likely[:-1]) | (owner[1:] != owner[:-1])
                head = np.flatnonzero(new)
                tail = np.append(head[1:], len(likely))[: len(head)]
                keep = ok[owner[head]]
                head, tail = head[keep], tail[keep]
                base = words.first[owner[head]]
                kinds = pa.array(names or ["und"], pa.string())
                runs = pa.StructArray.from_arrays([pa.array(head - base, pa.int32()), pa.array(tail - base, pa.int32()), kinds.take(pa.array(likely[head]))], ["start", "end", "lang"])
                cuts = pa.array(np.searchsorted(owner[head], np.arange(b - a + 1)), pa.int32())
                predicted = [names[j] if o else "und" for j, o in zip(best.tolist(), ok.tolist())]
                score = np.where(ok, mean[np.arange(b - a), best], 0.0).clip(0, 1)
                columns = [part.column("doc_id"), part.column("tag"), pa.array(predicted, pa.string()), pa.array(score), pa.ListArray.from_arrays(cuts, runs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "lang_pred", "score", "segments"])

    letters = F.col("text").rlike(r"\p{L}").alias("letters")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text", letters).mapInArrow(predict, OUT)


@query("op10_language_id")
def op10_language_id(spark, sf_dir):
    """Language of all documents, learned from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    tagger, names = learn(docs.where(~held_out(4, 2)))
    return identify(docs, tagger, names).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
