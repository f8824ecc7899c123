"""Token counts through a digest cache: what was counted once is never encoded again.

A text's content digest is the SHA-256 of its normalised form, a tokenizer's version digest that of its file.
The cache is a table of (tokenizer, content, n_tokens). Digests of the texts are joined to the counts stored
under the tokenizer; of the others one text per distinct digest is encoded, whole, and its count appended.

Normalised form: where a tokenizer lower-cases and drops white space (``blank_separated``), A-Z become a-z and
runs of the blanks \\x20 \\x09-\\x0D one space, none at the ends, which changes no count. Texts that hold ``<|``
keep their case, since special strings are told by it. For other tokenizers the form is the text itself.

Texts are shuffled once, by digest, one per digest and map task, and only the misses; all rows are counted
from digests. An append is one Parquet write, which shows whole or not at all; two runs that append at the same time may store a
count twice, and readers take one. A run that was stopped leaves the counts it had appended.

Defined results: a null text has 0 bytes and 0 tokens, as an empty one. Repeated rows stay repeated and each
has its count. Null ids stay null. Other columns stay; the added ones replace columns of their names, and
columns named ``_of _hot _key _cold`` go. An empty table gives an empty one and appends nothing.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.differencing_pack import tokenizer_at
from recordlens.llm.hashing import slices
from recordlens.session import read_if_there

LIMIT_TOKENS = 2048
HEAVY = 10_000
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"
ADDED = ("n_bytes", "n_tokens", "over_limit")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "[\\x20\\x09-\\x0D]+"


def version_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def blank_separated(path: str) -> bool:
    """Whether a tokenizer lower-cases, drops white space and ends its words by a mark of their own."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        parsed = json.load(f)
    steps = (parsed.get("normalizer") or {}).get("normalizers", [])
    kinds = [s["type"] for s in steps]
    folds = any(s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    splits = (parsed.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return (kinds == ["NFC", "Replace", "Lowercase"] and folds and splits.get("behavior") == "Removed"
            and "[^\\s\\p{L}\\p{N}]" in json.dumps(splits).replace("\\\\", "\\")
            and parsed["model"].get("end_of_word_suffix") == "</w>")


def normalised(text: Column, folds: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    if not folds:
        return text
    lowered = F.when(F.contains(text, F.lit("<|")), text).otherwise(F.translate(text, UPPER, LOWER))
    return F.trim(F.regexp_replace(lowered, BLANKS, " "))


def counter(path: str, folds: bool) -> Callable[[list[str]], list[int]]:
    """Token counts of a list of texts by the library that the file belongs to."""
    if folds:
        tokenizer = tokenizer_at(path, 0)
        return lambda texts: [len(ids) // 4 - 1 for ids in tokenizer.ids(texts)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(e.ids) for e in own.encode_batch_fast(texts, add_special_tokens=False)]


def encoded(misses: DataFrame, path: str, folds: bool) -> DataFrame:
    """content, n_tokens of rows of content and form."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(path, folds)
        for batch in batches:
            counts = [n for _, run in slices(list(batch["form"])) for n in tokens(run)]
            yield pd.DataFrame({"content": batch["content"], "n_tokens": counts})

    return misses.select("content", "form").mapInPandas(count, "content string, n_tokens long")


def stored_counts(documents: DataFrame, cache: str, version: str) -> DataFrame:
    """content, n_tokens of a tokenizer version in the cache, each content once."""
    spark = documents.sparkSession
    held = read_if_there(spark, cache)
    if held is None:
        held = spark.createDataFrame([], CACHE_SCHEMA)
    return held.where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(documents: DataFrame, path: str, cache: str, text: str = "text", limit: int = LIMIT_TOKENS) -> DataFrame:
    """The documents with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens).

    ``cache`` is the folder of the cache, shared by all executors; ``path`` a tokenizer file: .json is read by
    tokenizers, .model by sentencepiece.
    """
    version, folds = version_digest(path), blank_separated(path)
    form = normalised(F.col(text), folds)
    forms = documents.select(form.alias("form")).withColumn("content", F.sha2("form", 256))
    before = stored_counts(documents, cache, version)
    misses = forms.join(before, "content", "left_anti").groupBy("content").agg(F.any_value("form").alias("form"))
    counted = encoded(misses, path, folds).select(F.lit(version).alias("tokenizer"), "content", "n_tokens")
    counted.write.mode("append").parquet(cache)
    known = stored_counts(documents, cache, version)
    # The counts of contents that many rows hold go to the rows; theirs meet no other key in the join by digest.
    hot = known.join(heavy(forms), "content").select(F.col("content").alias("_of"), F.col("n_tokens").alias("_hot"))
    rows = documents.drop(*ADDED, "_of", "_hot", "_key", "_cold").withColumns({
        "n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "_of": F.sha2(form, 256)})
    rows = rows.join(F.broadcast(hot), "_of", "left")
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_of")).otherwise(
        F.concat(F.lit("-"), F.monotonically_increasing_id())))
    cold = known.select(F.col("content").alias("_key"), F.col("n_tokens").alias("_cold"))
    joined = rows.join(cold, "_key", "left").withColumn("n_tokens", F.coalesce("_hot", "_cold"))
    return joined.drop("_of", "_hot", "_key", "_cold").withColumn("over_limit", F.col("n_tokens") > limit)


def heavy(forms: DataFrame) -> DataFrame:
    """Contents that hold more than one row in HEAVY each: fewer than HEAVY, however large the table."""
    sizes = forms.groupBy("content").agg(F.count("*").alias("n")).where("n > 1")
    total = forms.count()
    return sizes.where(F.col("n") * HEAVY > total).select("content")
