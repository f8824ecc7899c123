"""Secret scan: fixed patterns, and a randomness test battery over encoded-looking tokens.

Tokens of ``MIN_TOKEN`` or more characters get the narrowest encoding that holds them (hex, base32, base62,
base64, base64url). A token within the fixed spans is found already; one that reaches beyond them is tested
whole. Under "each symbol is drawn evenly" three tests give p-values: chi-squared over alphabet bins,
Wald-Wolfowitz runs around the alphabet's middle, and lag-one serial correlation; Fisher's
method combines them. Random keys have ordinary combined values, words have minute ones.

False discoveries are controlled over the whole corpus and by length: letter-only tokens in ordinary case
are the null sample of each length band (and of the shorter bands, whose tests are weaker), a candidate's
p-value is the share of the null sample that looks at least as random, and within a band the largest
cut-off whose expected share of false finds is at most ``RATE`` is kept. Only counts by band and score
step (at most ``BANDS`` x ``STEPS`` x 4 rows) reach the driver. To each candidate its own text adds ``DRAWS`` tokens to
the null sample, words of the whole text drawn at random and joined to the length of the candidate's band (drawn once for
all its candidates of a band). This holds for
tables of any size; one find among n candidates needs about n / ``RATE`` null tokens. Only a table without words has none.

Letter-only tokens are candidates too, apart from the others: scored by their 26 letters, and held against all letter-only
tokens and ``LETTER_DRAWS`` tokens joined from shorter words for each text and band, scored alike. Only keys of some length
differ from words.

Defined results: a null or empty text has no spans. A null id stays null; repeated rows are scanned alike.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.session import cut

# Fixed patterns and their least lengths, in the order of the kinds.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
NAMES = ["passw", "secret", "token", "apikey", "api_key"]
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16

MIN_TOKEN = 20
TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
JOINABLE = re.compile(r"(?<!\S)(?:[A-Z]?[a-z]+|[A-Z]+)(?=[.,;:!?]?(?:\s|\Z))")
RATE = 0.05
DRAWS = 20
LETTER_DRAWS = 2 * DRAWS
PART = 500
BANDS = 16
STEPS = 256

# Fixed alphabets, narrowest first.
ALPHABETS = [
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base62", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
]
CODES = [(name, {c: i for i, c in enumerate(symbols)}, len(symbols)) for name, symbols in ALPHABETS]
LETTERS = ("letters", {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}, 26)

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"
FOUND = (f"n_assign long, n_access long, n_hex long, base_sha256 string, spans {SPAN}, "
         "tokens array<struct<start:int,end:int,band:int,step:int,word:boolean,letters:int>>, "
         "drawn_letters array<int>, drawn array<int>")


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the fixed patterns, by start and kind."""
    lower = text.lower()
    found = []
    if any(word in lower for word in NAMES):  # a text without any of the names is not searched
        found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LENGTH]
    # A greedy run of hex symbols of sufficient length is the same with or without its least length.
    found += [(m.start(), 2, "hex", m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def normal_tail(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, freedom: int) -> float:
    """Upper tail by the Wilson-Hilferty cube root."""
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(2 * spread))


def encoding_of(token: str) -> tuple[str, dict[str, int], int] | None:
    symbols = set(token)
    return next((e for e in CODES if symbols <= e[1].keys()), None)


def randomness(token: str, encoding: tuple[str, dict[str, int], int] | None = None) -> float:
    """Combined p-value of the battery under even random symbols; 0 where no encoding holds the token."""
    token = token.rstrip("=")
    encoding = encoding or encoding_of(token)
    n = len(token)
    if encoding is None or n < 8:
        return 0.0
    _, codes, size = encoding
    values = np.fromiter(map(codes.__getitem__, token), np.int64, n)
    bins = min(size, max(4, 1 << int(math.log2(n / 4))))
    share = np.bincount(np.arange(size) * bins // size, minlength=bins) / size
    counts = np.bincount(values * bins // size, minlength=bins)
    even = chi_squared_tail(float(((counts - n * share) ** 2 / (n * share)).sum()), bins - 1)
    high = values >= size // 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * a * b / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        order = normal_tail((runs - mean) / math.sqrt(variance))
    else:
        order = 2.0 ** (1 - n)
    spread = float(values.var())
    if spread:
        centred = values - values.mean()
        lag = float((centred[1:] * centred[:-1]).sum()) / (n * spread)
        serial = normal_tail((lag + 1 / n) * math.sqrt(n))
    else:
        serial = 1e-300
    half = -sum(math.log(max(p, 1e-300)) for p in (even, order, serial))
    return math.exp(-half) * (1 + half + half**2 / 2)


def step_of(p: float) -> int:
    """Score step: 0 looks most random, each step is an eighth of a power of ten less."""
    return min(STEPS - 1, int(-8 * math.log10(max(p, 1e-300))))


def band_of(length: int) -> int:
    """Length band: powers of the square root of two from MIN_TOKEN."""
    return max(0, min(BANDS - 1, int(2 * math.log2(length / MIN_TOKEN))))


def scan(text: str | None) -> tuple:
    """One row of FOUND."""
    text = text or ""
    spans = base_spans(text)
    covered: list[list[int]] = []  # the spans without overlaps
    for start, _, _, end in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    tokens, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] <= start and end <= covered[at][1]:
            continue
        token = m[0]
        word = bool(WORD.fullmatch(token))
        letters = step_of(randomness(token.lower(), LETTERS)) if word else None
        tokens.append((start, end, band_of(end - start), step_of(randomness(token)), word, letters))
    counts = [sum(s[1] == k for s in spans) for k in range(3)]
    others, words = (sorted({t[2] for t in tokens if t[4] == word}) for word in (False, True))
    return (*counts, hashlib.sha256(joined(spans).encode()).hexdigest(), spans, tokens,
            joined_words(text, words, LETTER_DRAWS, LETTERS), joined_words(text, others))


def joined_words(text: str, bands: list[int], draws: int = DRAWS,
                 encoding: tuple[str, dict[str, int], int] | None = None) -> np.ndarray:
    """band * STEPS + step of ``draws`` tokens for each of the bands, joined from words of the text to the least length.

    They are the same for equal texts; there are none without words.
    """
    words = [w.lower() for w in JOINABLE.findall(text)] if bands else []
    if encoding:  # letter-only candidates are no part of their own null sample
        words = [w for w in words if len(w) < MIN_TOKEN]
    if not words:
        return np.zeros(0, np.int32)
    rng, found = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))), []
    for band in bands:
        least = MIN_TOKEN * 2 ** (band / 2)
        for _ in range(draws):
            token = ""
            while len(token) < least:
                token += "".join([words[i] for i in rng.integers(len(words), size=4)])
            token = token[:math.ceil(least)]
            found.append(band_of(len(token)) * STEPS + step_of(randomness(token, encoding)))
    return np.array(found, np.int32)


def cut_offs(counts: dict[tuple[int, int, bool], int], rate: float = RATE) -> dict[int, int]:
    """Largest accepted score step by band; a band without any is absent."""
    words, others = np.zeros((BANDS, STEPS)), np.zeros((BANDS, STEPS))
    for (band, step, word), n in counts.items():
        (words if word else others)[band, step] += n
    null = np.cumsum(words, axis=0)
    chance = (1 + np.cumsum(null, axis=1)) / (1 + null.sum(axis=1, keepdims=True))
    found = np.cumsum(others, axis=1)
    expected = chance * others.sum(axis=1, keepdims=True)
    accepted = (found > 0) & (expected <= rate * found)
    return {b: int(np.flatnonzero(accepted[b]).max()) for b in range(BANDS) if accepted[b].any()}


def tested(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the columns of FOUND: the fixed spans and the tested tokens of every whole text."""
    names = [f.split()[0] for f in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "tokens", "drawn_letters", "drawn")]

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for at in range(0, len(texts), PART):
                part = texts.iloc[at : at + PART]
                yield pd.DataFrame([scan(t if isinstance(t, str) else None) for t in part], columns=names)

    return documents.select(F.col(key).alias(key), found(F.col(text)).alias("found")).select(key, "found.*")


def find_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """key, counts and digest of the fixed spans, and ``spans``: all spans as array of structs by start.

    Spans of the battery have kind ``random`` and rank 3.
    """
    rows = cut(tested(documents, key, text), "secrets")
    code = lambda band, step, word, letters: ((letters * BANDS + band) * STEPS + step) * 2 + word
    one = lambda c, n=F.lit(1): F.struct(c.cast("int").alias("code"), n.cast("long").alias("n"))
    # A text's draws of a band count once for each of its candidates there, those for letter-only tokens once.
    alike = lambda d: F.size(F.filter("tokens", lambda t: ~t.word & (t.band == F.floor(d / STEPS))))
    by_letters = F.filter("tokens", lambda t: t.word)
    codes = F.concat(
        F.transform("tokens", lambda t: one(code(t.band, t.step, t.word.cast("int"), 0))),
        F.transform("drawn", lambda d: one(d * 2 + 1, alike(d))),
        *[F.transform(by_letters, lambda t, k=k: one(code(t.band, t.letters, k, 1))) for k in (0, 1)],
        F.transform("drawn_letters", lambda d: one((d + BANDS * STEPS) * 2 + 1)))
    counted = rows.select(F.inline(codes)).groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts: list[dict] = [{}, {}]
    for r in counted:
        letters, place = divmod(r.code // 2, BANDS * STEPS)
        counts[letters][place // STEPS, place % STEPS, bool(r.code % 2)] = r.n
    limits = [cut_offs(c, rate) for c in counts]

    def within(step: F.Column, band: F.Column, limit: dict[int, int]) -> F.Column:
        if not limit:
            return F.lit(False)
        most = F.create_map(*[F.lit(x) for b, s in limit.items() for x in (b, s)])
        return F.coalesce(step <= F.try_element_at(most, band), F.lit(False))

    extra = F.transform(
        F.filter("tokens", lambda t: F.when(t.word, within(t.letters, t.band, limits[1])).otherwise(
            within(t.step, t.band, limits[0]))),
        lambda t: F.struct(t.start.alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"),
                           t.end.alias("end")))
    return rows.withColumn("spans", F.array_sort(F.concat("spans", extra))).drop("tokens", "drawn_letters", "drawn")


def spans_text(spans) -> F.Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
