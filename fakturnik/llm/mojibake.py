"""Text decoded with the wrong character encoding: found and restored by expectation-maximization.

Model. A document has a latent encoding chain: clean, or one of the CHAINS (bytes of one encoding read
as another, once or twice, or lost to replacement signs). Given the chain, each of its suspicious words
is garbled by it or left as it was, with a rate of its own per word. A word's likelihood mixes a
character trigram model and the word counts of the whole corpus; a garbled word has the likelihood of
its inverse; a word left as it was may also be foreign, with signs that are all about as likely. The steps:

* words of all records are counted (combined before the shuffle); the trigram table is folded from the
  counts over an alphabet of at most 49 classes, so it has at most 117,649 rows and is sent to the workers;
* words with signs outside the plain alphabet get their inverse and log-likelihood ratio for each chain; a
  word that stands in far more documents than its inverse is hardly its garbled form (most text is clean),
  so the ratio falls by what the two counts say against it;
* E step: chain posteriors per document (evidence of all its pages and its whole text is pooled, with the
  chain prior of its pool), then the chance of each of its words to be garbled; one pass over one row per document;
* M step: chain priors per pool (the kind of source of the document and the fields that hold it), and the
  garbling rate of each word over all documents, which clears words that occur mostly in documents without
  further evidence (foreign names, symbols);
* a record is a case if one of its words is more likely garbled than not; each such word is replaced by
  the inverse that the posterior favours.

Defined cases: null and empty texts are never cases and stay as they are; words that have lost signs
(replacement character) make a case but are left as they stand (restorable false); repeated rows count
once; texts of any length are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

POLISH = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ"

#: (name, encoding the bytes were written in, encoding they were read as, times). Fixed names of public encodings.
CHAINS = (
    ("utf8>cp1252", "utf-8", "cp1252", 1),
    ("utf8>latin1", "utf-8", "latin-1", 1),
    ("utf8>cp1250", "utf-8", "cp1250", 1),
    ("utf8>latin2", "utf-8", "iso8859-2", 1),
    ("utf8>cp852", "utf-8", "cp852", 1),
    ("utf8>cp437", "utf-8", "cp437", 1),
    ("utf8>cp850", "utf-8", "cp850", 1),
    ("utf8>maclatin2", "utf-8", "mac_latin2", 1),
    ("utf8>macroman", "utf-8", "mac_roman", 1),
    ("utf8>cp1251", "utf-8", "cp1251", 1),
    ("utf8>cp1257", "utf-8", "cp1257", 1),
    ("utf8>cp1252 twice", "utf-8", "cp1252", 2),
    ("utf8>latin1 twice", "utf-8", "latin-1", 2),
    ("utf8>cp1250 twice", "utf-8", "cp1250", 2),
    ("utf8>latin2 twice", "utf-8", "iso8859-2", 2),
    ("cp1250>cp1252", "cp1250", "cp1252", 1),
    ("latin2>cp1252", "iso8859-2", "cp1252", 1),
    ("cp1250>latin2", "cp1250", "iso8859-2", 1),
    ("latin2>cp1250", "iso8859-2", "cp1250", 1),
    ("cp852>cp1250", "cp852", "cp1250", 1),
    ("cp852>cp1252", "cp852", "cp1252", 1),
    ("cp852>latin2", "cp852", "iso8859-2", 1),
    ("cp1250>cp852", "cp1250", "cp852", 1),
    ("latin2>cp852", "iso8859-2", "cp852", 1),
    ("maclatin2>cp1250", "mac_latin2", "cp1250", 1),
    ("maclatin2>cp1252", "mac_latin2", "cp1252", 1),
)
LOST = "lost"
#: Signs of clean text that are no letters, and letters of other languages.
NO_LETTER, LATIN = re.compile("[„”–—…°²±§\u00a0³‚‘’“«»€½¼]"), re.compile("[À-ÖØ-öø-ſ]")
#: Share of the documents with a word or its garbled form in which it is garbled at most, before this speaks against it.
MOST_GARBLED = 0.5
#: Signs beyond ASCII that stand in clean Polish text and need no explanation.
PLAIN = POLISH + "„”–—…°²±§ "
SPACE = " \t\n\r\f\x0b"
ROUNDS = 3
#: Log of the share of words that are foreign or symbols and right as they are.
FOREIGN = -6.9
#: Share of documents taken to be garbled, and of words garbled in such a document, before any round.
PRIOR_GARBLED, PRIOR_WORD = 0.03, 0.3


@lru_cache(maxsize=32)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Sign to byte of a single-byte encoding; bytes it leaves undefined stand for the control of the same number."""
    out = {}
    for b in range(256):
        try:
            sign = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            sign = chr(b)
        out.setdefault(sign, b)
    return out


def undo(word: str, written: str, read: str, times: int = 1) -> str | None:
    """The word before it was read in the wrong encoding, or None if that cannot have happened."""
    table = _bytes_of(read)
    for _ in range(times):
        raw = bytearray()
        for c in word:
            b = table.get(c)
            if b is None:
                return None
            raw.append(b)
        try:
            word = raw.decode(written)
        except UnicodeDecodeError:
            return None
    return word


def _fold(word: Column) -> Column:
    """The word over the model's alphabet: small letters, Polish capitals, A, 0, '.' and '?' for all else."""
    w = F.regexp_replace(word, "[A-Z]", "A")
    w = F.regexp_replace(w, "[0-9]", "0")
    w = F.regexp_replace(w, r"[!-/:-@\[-`{-~]", ".")
    return F.regexp_replace(w, f"[^a-zA0.{POLISH}]", "?")


def _fold_here(word: str) -> str:
    w = re.sub("[A-Z]", "A", word)
    w = re.sub("[0-9]", "0", w)
    w = re.sub(r"[!-/:-@\[-`{-~]", ".", w)
    return re.sub(f"[^a-zA0.{POLISH}]", "?", w)


class Trigrams:
    """Interpolated trigram model over folded words."""

    def __init__(self, counts: dict[str, float]):
        self.tri, self.bi, self.one, self.ctx2, self.ctx1 = dict(counts), {}, {}, {}, {}
        for g, n in counts.items():
            self.bi[g[1:]] = self.bi.get(g[1:], 0) + n
            self.one[g[2]] = self.one.get(g[2], 0) + n
            self.ctx2[g[:2]] = self.ctx2.get(g[:2], 0) + n
            self.ctx1[g[1]] = self.ctx1.get(g[1], 0) + n
        self.total = max(1.0, sum(counts.values()))

    def log(self, word: str) -> float:
        folded, out = "^^" + _fold_here(word) + "$", 0.0
        for i in range(2, len(folded)):
            a, b, c = folded[i - 2], folded[i - 1], folded[i]
            p = (
                0.9 * self.tri.get(a + b + c, 0) / max(1.0, self.ctx2.get(a + b, 0))
                + 0.09 * self.bi.get(b + c, 0) / max(1.0, self.ctx1.get(b, 0))
                + 0.0099 * self.one.get(c, 0) / self.total
                + 1e-5
            )
            out += math.log(p) - (7.0 if c == "?" else 3.2 if c == "A" else 2.3 if c in "0." else 0.0)
        return out


def foreign(word: str) -> float:
    """Log-likelihood of a word of another language or a run of symbols: each sign about as likely as any other."""
    return FOREIGN + sum(-3.7 if c < "\x7f" or c in POLISH else -4.6 for c in word)


def records(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """All texts as one table: field, doc_id, number (0 for the whole text), source (kind of file, where known), text."""
    kind = F.col("pdf_type") if "pdf_type" in contents.columns else F.lit(None)
    a = pages.select(F.lit("pdf_pages.text").alias("field"), F.col("doc_id").cast("bigint"), F.col("number").cast("int"), F.lit(None).cast("string").alias("source"), "text")
    b = contents.select(F.lit("pdf_contents.text").alias("field"), F.col("doc_id").cast("bigint"), F.lit(0).alias("number"), kind.cast("string").alias("source"), "text")
    return a.unionByName(b)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


#: A sign beyond ASCII that is not plain, or a capital of Polish behind a small letter. The first test fails at once for ASCII.
ODD = rf"[^\x00-\x7f](?:(?<![{PLAIN}])|(?<=[a-z{POLISH[:9]}][{POLISH[9:]}]))"


def _suspicious(word: Column) -> Column:
    return word.rlike(ODD)


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all records; words without a letter or with only digits and signs carry no evidence."""
    w = rows.filter(F.col("text").isNotNull()).select(F.explode(_words(F.col("text"))).alias("word"))
    return w.filter(F.col("word").rlike(r"[a-zA-Z]|[^\x00-\x7f]")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def trigram_table(counts: DataFrame) -> dict[str, float]:
    """Trigram counts of the plain words; at most 49 cubed rows by its alphabet."""
    plain = counts.filter(~_suspicious(F.col("word"))).select(F.concat(F.lit("^^"), _fold(F.col("word")), F.lit("$")).alias("w"), "n")
    grams = plain.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("g"), "n")
    return {r["g"]: float(r["n"]) for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}


def inverses(counts: DataFrame, model: dict[str, float]) -> DataFrame:
    """(word, n, chain, fixed, base, gain): each suspicious word under each chain that can have made it.

    gain is the log-likelihood of the inverse, base that of the word as it stands.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = Trigrams(model)
        for pdf in batches:
            out = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                if "�" in word:
                    out.append((word, n, LOST, word, 0.0, 40.0))
                    continue
                base = max(lm.log(word), foreign(word))
                for name, written, read, times in CHAINS:
                    fixed = undo(word, written, read, times)
                    if fixed is None or fixed == word:
                        continue
                    if "?" not in _fold_here(NO_LETTER.sub("", fixed)):
                        out.append((word, n, name, fixed, base, lm.log(fixed)))
                    elif written == "utf-8" and "?" not in _fold_here(NO_LETTER.sub("", LATIN.sub("e", fixed))):
                        # Letters of other languages: only sequences of several bytes prove that they were there.
                        out.append((word, n, name, fixed, base, max(lm.log(fixed), foreign(fixed))))
            yield pd.DataFrame(out, columns=["word", "n", "chain", "fixed", "base", "gain"])

    return counts.filter(_suspicious(F.col("word"))).mapInPandas(run, "word string, n bigint, chain string, fixed string, base double, gain double")


def evidence(rows: DataFrame, spread_of: DataFrame) -> DataFrame:
    """Suspicious words with their chains: (word, chain, fixed, llr).

    The likelihood of an inverse mixes trigram model and word counts half and half. ``spread_of`` gives the
    number of documents of each suspicious word: if it is garbled in d of d + m documents, m being the
    occurrences of the inverse, and that is more than MOST_GARBLED of them, the divergence of the two shares
    times d + m is taken off.
    """
    counts = cut(word_counts(rows), "words")
    model = trigram_table(counts)
    total = counts.agg(F.sum("n")).first()[0] or 1
    found = inverses(counts, model).join(spread_of, "word")
    mixed = found.join(counts.select(F.col("word").alias("fixed"), F.col("n").alias("seen")), "fixed", "left")
    log_total = F.lit(float(math.log(total)))
    as_word = F.when(F.col("seen").isNotNull(), F.log(F.col("seen").cast("double")) - log_total - 0.7)
    d, m = F.col("docs").cast("double"), F.coalesce(F.col("seen"), F.lit(0)).cast("double")
    q = d / (d + m)
    apart = d * F.log(q / MOST_GARBLED) + F.when(m > 0, m * F.log((1 - q) / (1 - MOST_GARBLED))).otherwise(0.0)
    against = F.when((q > MOST_GARBLED) & (F.col("chain") != LOST), apart).otherwise(0.0)
    llr = F.greatest(F.col("gain"), F.coalesce(as_word, F.lit(-1e9))) - F.col("base") - against
    return mixed.select("word", "chain", "fixed", llr.alias("llr")).filter("llr > 0")


NAMES = [c[0] for c in CHAINS] + [LOST]


def _e_step(shares: dict[str, list[float]], otherwise: float):
    """One pass over documents (doc_id, pool, items of word, chain, fixed, llr, rate).

    Gives per document the posterior of each chain, and per word the chance to be garbled with the likeliest chain and inverse.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, len(NAMES)
            items = batch.column("items")
            flat, sizes = items.flatten(), np.diff(np.asarray(items.offsets))
            row = np.repeat(np.arange(n), sizes)
            codes = flat.field("chain").dictionary_encode()
            chain = np.array([NAMES.index(c) for c in codes.dictionary.to_pylist()], dtype=np.int64)[np.asarray(codes.indices)] if len(row) else np.zeros(0, dtype=np.int64)
            llr, rate = np.asarray(flat.field("llr")), np.asarray(flat.field("rate"))
            lift = np.exp(np.minimum(llr, 60.0))
            mixture = 1 - rate + rate * lift
            # Evidence of a document for a chain: the sum over its words of the log of the mixture.
            gain = np.bincount(row * k + chain, weights=np.log(mixture), minlength=n * k).reshape(n, k)
            there = np.bincount(row * k + chain, minlength=n * k).reshape(n, k) > 0
            share = np.array([shares.get(p, [otherwise] * k) for p in batch.column("pool").to_pylist()]).reshape(n, k)
            score = np.where(there, gain + np.log(share), -np.inf)
            top = np.maximum(score.max(axis=1, initial=0.0), 0.0)
            e = np.exp(score - top[:, None])
            pz = e / (e.sum(axis=1) + np.exp(-top))[:, None]
            p = pz[row, chain] * rate * lift / mixture
            # One entry per document and word: the sum over its chains, and the likeliest of them.
            words = flat.field("word").dictionary_encode()
            key = row * max(1, len(words.dictionary)) + np.asarray(words.indices) if len(row) else row
            order = np.lexsort((-chain, -p, key))
            first = np.ones(len(order), dtype=bool)
            first[1:] = key[order][1:] != key[order][:-1]
            starts = np.flatnonzero(first)
            total = np.minimum(1.0, np.add.reduceat(p[order], starts)) if len(order) else p
            best = pa.array(order[starts])
            said = pa.StructArray.from_arrays([flat.field("word").take(best), flat.field("chain").take(best), flat.field("fixed").take(best), pa.array(total)], names=["word", "chain", "fixed", "p"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[order[starts]], minlength=n))]).astype(np.int32)
            seen = [np.flatnonzero(t) for t in there]
            at = np.concatenate([[0], np.cumsum([len(c) for c in seen])]).astype(np.int32)
            flat_seen = np.concatenate(seen) if n else np.zeros(0, dtype=np.int64)
            chains = pa.StructArray.from_arrays([pa.array([NAMES[c] for c in flat_seen], pa.string()), pa.array(pz[np.repeat(np.arange(n), np.diff(at)), flat_seen])], names=["chain", "pz"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("pool"), pa.ListArray.from_arrays(pa.array(at), chains), pa.ListArray.from_arrays(pa.array(ends), said)], names=["doc_id", "pool", "chains", "words"]
            )

    return run


JUDGED = "doc_id bigint, pool string, chains array<struct<chain:string,pz:double>>, words array<struct<word:string,chain:string,fixed:string,p:double>>"


def posteriors(rows: DataFrame) -> DataFrame:
    """(field, doc_id, number, word, chain, fixed, p): the chance that a word of a record is garbled, and its best inverse."""
    said = rows.filter(F.col("text").isNotNull() & _suspicious(F.col("text"))).select(
        "field", "doc_id", "number", F.explode(F.array_distinct(F.filter(_words(F.col("text")), _suspicious))).alias("word")
    )
    said = cut(said, "occurrences")
    in_doc = said.select("doc_id", "word").distinct()
    tokens = evidence(rows, in_doc.groupBy("word").agg(F.count(F.lit(1)).alias("docs")))
    every = rows.groupBy("doc_id").agg(F.concat_ws("|", F.coalesce(F.max("source"), F.lit("")), F.sort_array(F.collect_set("field"))).alias("pool"))
    every = cut(every, "pools")
    # (doc_id, pool, word, chain, fixed, llr): the documents with evidence, a small part of all.
    heard = cut(in_doc.join(tokens, "word").join(every, "doc_id"), "evidence")
    # Pools are few (kinds of file times sets of fields); their chain shares go to the workers.
    docs_of = {r["pool"]: r["n"] for r in every.groupBy("pool").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares: dict[str, list[float]] = {}
    rates = judged = None
    for at in range(ROUNDS + 1):
        rate = F.lit(PRIOR_WORD) if rates is None else F.coalesce(F.col("rate"), F.lit(PRIOR_WORD))
        w = heard if rates is None else heard.join(rates, "word", "left")
        by_doc = w.groupBy("doc_id", "pool").agg(F.collect_list(F.struct("word", "chain", "fixed", "llr", rate.alias("rate"))).alias("items"))
        judged = cut(by_doc.mapInArrow(_e_step(shares, PRIOR_GARBLED / len(CHAINS) if at == 0 else 1e-5), JUDGED), f"judged-{at}")
        if at == ROUNDS:
            break
        # M step. Documents without suspicious words count as clean through the total of their pool.
        z = judged.select("pool", F.explode("chains").alias("c")).groupBy("pool", "c.chain").agg(F.sum("c.pz").alias("z")).collect()
        shares = {p: [1e-5] * len(NAMES) for p in docs_of}
        for r in z:
            shares[r["pool"]][NAMES.index(r["chain"])] = max(1e-6, min(0.2, r["z"] / docs_of[r["pool"]]))
        rates = judged.select(F.explode("words").alias("w")).groupBy("w.word").agg(F.least(F.lit(0.98), F.greatest(F.lit(1e-4), (F.sum("w.p") + 0.3) / (F.count(F.lit(1)) + 1.0))).alias("rate"))
    sure = judged.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.*")
    return said.join(sure, ["doc_id", "word"]).select("field", "doc_id", "number", "word", "chain", "fixed", "p").distinct()


def garbled_words(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Words of records that are more likely garbled than not."""
    return posteriors(records(pages, contents)).filter("p > 0.5")


def found(pages: DataFrame, contents: DataFrame) -> DataFrame:
    return garbled_words(pages, contents).select("doc_id", "number").distinct()


def restore(pages: DataFrame, contents: DataFrame) -> DataFrame:
    """Every case with its text restored: field, doc_id, number, chain, text, restorable."""
    rows = records(pages, contents)
    words = garbled_words(pages, contents)
    by_record = words.groupBy("field", "doc_id", "number").agg(
        F.collect_list(F.struct("word", "fixed")).alias("swaps"),
        F.mode("chain").alias("chain"),
        F.min((F.col("chain") != LOST).cast("int")).cast("boolean").alias("restorable"),
    )
    cases = rows.join(by_record, ["field", "doc_id", "number"]).dropDuplicates(["field", "doc_id", "number"])  # only the texts of cases are moved
    schema = "field string, doc_id bigint, number int, chain string, text string, restorable boolean"
    cutter = re.compile(f"([{SPACE}]+)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for text, swaps in zip(pdf["text"], pdf["swaps"], strict=True):
                new = {s["word"]: s["fixed"] for s in swaps}
                texts.append("".join(new.get(part, part) for part in cutter.split(text)))
            yield pdf.assign(text=texts)[["field", "doc_id", "number", "chain", "text", "restorable"]]

    return cases.mapInPandas(run, schema)
