"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior for each document:

- its text: likelihoods of hashed byte trigrams, counted over all documents with
  a declared language (the counts are sums by language and trigram, at most
  languages x 65,536 rows),
- the language it declares, which is right with a given probability; the case and
  the parts behind the first (en-US) of a declaration do not count,
- the suffix of its host, whose languages are counted over all documents,
- its host: counted languages, smoothed towards those of the suffix, which are
  smoothed towards those of all documents.

A document's own declaration counts as declaration alone: its text is left out of
the trigram counts of its language, and the document itself out of the counts of
its host, its suffix and of all, when it is judged.

A document is rejected if no letter is in it or no language reaches the least
posterior.

Defined results: null text counts as empty and is rejected; null or blank
declarations say nothing; a null host takes the prior of all null hosts; ties go
to the language that is smaller; without any declared language every document
has none and is rejected; repeated rows are judged alike; in fuse() further
columns stay, but for one named lid, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, table, unused, written

GRAMS = 1 << 16
#: Languages whose counts a task holds before it hands them on, and hosts whose priors it remembers.
HELD = 64
#: A declaration is right with this probability.
DECLARED = 0.9
#: Weight of the upper level in host and suffix priors, in documents.
HOST_PRIOR, SUFFIX_PRIOR = 20.0, 50.0
#: Trigrams of one text are not independent: together they weigh as so many.
EVIDENCE = 60
#: Count that every trigram has besides.
EXTRA = 0.5
LEAST = 0.5
#: What a page does not show.
HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, one text after another, and where each text begins. Letters only; case of A-Z is dropped."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + b"  ", np.uint8)
    data = CLASS[data]
    g = (data[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA77)) ^ (data[2:].astype(np.uint32) * np.uint32(0xC2B2AE3D))
    g = ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    g[data[1:-1] == 32] = GRAMS  # a trigram counts by the letter in its middle
    return g.astype(np.int32), np.concatenate(([0], np.cumsum(sizes)[:-1]))


#: Bytes as they count: letters in lower case, all bytes of other alphabets, the rest as space.
CLASS = np.array([b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def _texts(batch: pd.Series) -> list[bytes]:
    return [b" " + (x or "").encode() for x in batch]


def suffix(host: Column) -> Column:
    """What follows the last dot of the host; empty without one."""
    return F.when(F.coalesce(host, F.lit("")).contains("."), F.lower(F.substring_index(host, ".", -1))).otherwise(F.lit(""))


def language(declared: Column) -> Column:
    """The language of a declaration: its first part in lower case, so en, EN and en-US are one; null if blank."""
    low = F.lower(F.btrim(F.regexp_extract(F.coalesce(declared.cast("string"), F.lit("")), r"^[^-_]*", 0)))
    return F.when(low != "", low)


def fit(docs: DataFrame, declared: str = "lang", host: str = "source") -> tuple[list[str], np.ndarray, np.ndarray, DataFrame]:
    """(languages, counts of each trigram by language, documents of each language, _priors() of the hosts)."""
    said = docs.select(F.col(host).alias("host"), language(F.col(declared)).alias("l"), "text")
    counts = written(said.groupBy("host", "l").agg(F.count("*").alias("n")))
    every = {r["l"]: r["n"] for r in counts.where("l IS NOT NULL").groupBy("l").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(every)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for x, own in sums.items():
                gram = np.flatnonzero(own[:GRAMS])
                yield pd.DataFrame({"at": place[x], "gram": gram, "n": own[gram]})
            sums.clear()

        for batch in batches:
            for x, part in batch.groupby("l"):
                if x not in sums and len(sums) == HELD:
                    yield from counted()
                sums[x] = sums.get(x, 0) + np.bincount(_grams(_texts(part["text"]))[0], minlength=GRAMS + 1)
        yield from counted()

    named = said.where("l IS NOT NULL").select("l", "text")
    grams = named.mapInPandas(count, "at int, gram int, n long").groupBy("at", "gram").agg(F.sum("n").alias("n")).toPandas()
    whole = np.zeros((len(languages), GRAMS + 1), np.float32)
    whole[grams["at"], grams["gram"]] = grams["n"]
    return languages, whole, np.array([every[x] for x in languages], float), _priors(counts)


def _priors(counts: DataFrame) -> DataFrame:
    """host, and the languages declared on it (l, n) and under its suffix (sl, sn), from counts (host, l, n); a written table."""
    counts = counts.withColumn("suffix", suffix(F.col("host")))
    both = F.sort_array(F.collect_list(F.when(F.col("l").isNotNull(), F.struct("l", "n"))))
    suffixes = written(counts.groupBy("suffix", "l").agg(F.sum("n").alias("n")).groupBy("suffix").agg(both.alias("s")))
    hosts = counts.groupBy("host", "suffix").agg(both.alias("h")).join(small(suffixes), "suffix")
    return written(hosts.select("host", F.col("h.l").alias("l"), F.col("h.n").alias("n"), F.col("s.l").alias("sl"), F.col("s.n").alias("sn")))


def fuse(docs: DataFrame, declared: str = "lang", host: str = "source", least: float = LEAST) -> DataFrame:
    """docs with lid: struct(lang, posterior, text_lang, kept). The texts stay where they are read, unless there are very many hosts."""
    languages, counts, every, priors = fit(docs, declared, host)
    n = len(languages)
    place = {x: i for i, x in enumerate(languages)}

    def likelihoods(texts: pd.Series, said: pd.Series, logs: np.ndarray, totals: np.ndarray) -> Iterator[np.ndarray]:
        """For each text the logarithms of its likelihoods, and whether there is a letter at all."""
        for start in range(0, len(texts), 256):  # bounds what is in memory beside the texts
            grams, begins = _grams(_texts(texts.iloc[start : start + 256]))
            real = np.add.reduceat((grams < GRAMS).astype(np.int64), begins)
            sums = np.column_stack([np.add.reduceat(logs[i][grams], begins, dtype=np.float64) for i in range(n)])
            for row, (lo, hi, name) in enumerate(zip(begins, [*begins[1:], len(grams)], said.iloc[start : start + 256], strict=True)):
                if name is not None:  # the text itself is in the counts of its language
                    own, times = np.unique(grams[lo:hi], return_counts=True)
                    own, times = own[own < GRAMS], times[own < GRAMS]
                    at = place[name]
                    sums[row, at] = times @ np.log(np.maximum(counts[at, own] - times, 0) + EXTRA) - real[row] * np.log(totals[at] - real[row])
            scale = np.where(real > 0, np.minimum(real, EVIDENCE) / np.maximum(real, 1), 0.0)
            yield from np.column_stack([sums * scale[:, None], real > 0])

    if not n:
        nothing = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"))
        return docs.withColumn("lid", nothing)
    wrong = float(np.log((1 - DECLARED) / max(1, n - 1)))
    right = float(np.log(DECLARED))

    def levels(own: int | None, names, counted, above_names, above_counted) -> np.ndarray:
        """Logarithms of the host's prior, without the document itself, which declares the language of that place."""
        shares = (every - _one(n, own) + 1) / (every.sum() - (own is not None) + n)
        for weight, names_, counted_ in ((SUFFIX_PRIOR, above_names, above_counted), (HOST_PRIOR, names, counted)):
            held = -_one(n, own)
            held[[place[x] for x in names_]] += counted_
            shares = (held + weight * shares) / (held.sum() + weight)
        return np.log(shares)

    # likelihoods and priors meet in one function, so that no task runs two Python workers
    @F.pandas_udf("lang string, posterior double, text_lang string, kept boolean")
    def judged(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        totals = counts[:, :GRAMS].sum(1, dtype=np.float64) + EXTRA * GRAMS
        logs = np.log(counts + np.float32(EXTRA)) - np.log(totals).astype(np.float32)[:, None]
        logs[:, GRAMS] = 0
        known: dict = {}
        for texts, *batch in batches:
            rows = []
            for text, said, at, *prior in zip(likelihoods(texts, batch[0], logs, totals), *batch, strict=True):
                if not text[n]:
                    rows.append((None, 0.0, None, False))
                    continue
                own = None if said is None else place[said]
                if (at, own) not in known:
                    if len(known) >= HELD * n:
                        known.clear()
                    known[at, own] = levels(own, *prior)
                both = text[:n] + known[at, own]
                if own is not None:
                    both = both + wrong
                    both[own] += right - wrong
                # argmax gives the first of equal values: languages are in order
                best = int(np.argmax(both))
                posterior = float(1 / np.exp(both - both[best]).sum())
                rows.append((languages[best], posterior, languages[int(np.argmax(text[:n]))], posterior >= least))
            yield pd.DataFrame(rows, columns=["lang", "posterior", "text_lang", "kept"])

    said, *names = unused(docs, "said", "host", "l", "n", "sl", "sn")
    scored = docs.withColumn(said, language(F.col(declared)))
    priors = priors.select(*(F.col(c).alias(name) for c, name in zip(("host", "l", "n", "sl", "sn"), names, strict=True)))
    joined = scored.join(small(priors, BROADCAST_ROWS // n), F.col(host).eqNullSafe(F.col(names[0])))
    return joined.withColumn("lid", judged(*map(F.col, ("text", said, *names)))).select(*(c for c in docs.columns if c != "lid"), "lid")


def _one(n: int, at: int | None) -> np.ndarray:
    """Zeros with a one at a place, if there is one."""
    out = np.zeros(n)
    if at is not None:
        out[at] = 1
    return out


def visible(html: Column) -> Column:
    """What a page shows: its text without comments, scripts, styles and tags; null for null."""

    @F.pandas_udf("string")
    def shown(pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unescape(HIDDEN.sub(" ", x)) for x in pages], dtype=object)

    return shown(html)


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text, lang (of the html tag) and source (the host of the url) of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    tag = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b([^>]*)>", 1)
    lang = F.regexp_extract(tag, r"(?i)(?:^|\s)(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)", 1)
    return pages.select("page_id", visible(F.col("html")).alias("text"), F.when(lang != "", lang).alias("lang"), F.when(host != "", host).alias("source"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents (page_id null) and pages (doc_id null), judged together: only pages have hosts with suffixes and declare in their markup."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    # written, so that pages are stripped once and no task runs two Python workers
    both = docs.unionByName(written(page_rows(table(spark, sf_dir, "pages"))), allowMissingColumns=True)
    return fuse(both).select("doc_id", "page_id", "lid.lang", F.round("lid.posterior", 6).alias("posterior"), "lid.text_lang", "lid.kept")
