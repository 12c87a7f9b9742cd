"""Noise in text from scanned pages: furniture, words cut at line ends and misread characters.

* Furniture: lines are judged by their place on the page (first, last, page number, repetition as first
  line of the other pages of the document); running headings and page numbers leave the text.
* Editor: an averaged perceptron reads a text sign by sign and predicts keep, replace, delete, insert (a sign
  behind the one that is kept) or, at a line end, join. It is trained on frequent words of the corpus itself,
  garbled by the usual confusions of recognition, with signs lost, and cut at line ends.
* Cut words: the editor proposes the line ends at which a join is not ruled out (its limit keeps all but JOINS_LOST
  of the cuts that it has not seen in training); the proposal is accepted when a mark stands there, or when neither part alone
  but only the whole is a word of the corpus; a compound that the corpus writes with a hyphen keeps it.
* Misread characters: the editor's best edit sequence and all sequences of up to three of the usual edits,
  ranked by it, are proposals; a proposal is accepted when the corpus has it far more often than the word
  as read. A word that holds signs that no word holds becomes the editor's best sequence without them.

Counts cover every word of every record, taken inside lines, so that cut parts do not count as words.
Words are edited once per distinct form; counts are joined, not collected.

Defined cases: null and empty texts have no lines and no case; repeated records count once; words of
one or two letters and numbers are never edited; words of over LONG_WORD signs take single edits and the
editor's best sequence; lines of tables are left alone; a single-page document has a heading only if its
first line looks like one of the usual headings; a page without lines is kept
empty; further columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .names import FOLD, distance

#: What recognition makes of letters (right, read); the noise that the editor is trained on.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("g", "9"), ("z", "2"), ("a", "@"), ("t", "†"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("d", "cl"), ("k", "lc"), ("h", "li"),
    ("w", "vv"), ("e", "c"), ("ą", "q"), ("ę", "ç"), ("ł", "t"), ("ł", "l"), ("P", "F"), ("b", "6"), ("B", "8"), ("O", "0"), ("I", "l"), ("l", "I"), ("l", "|"), ("S", "5"), ("Z", "2"), ("G", "6"),
    ("c", "e"), ("ó", "6"), ("ó", "o"), ("ż", "z"), ("ź", "z"), ("ś", "s"), ("ć", "c"), ("ń", "n"), ("rn", "m"), ("cl", "d"), ("E", "F"), ("j", "i"), ("n", "u"), ("u", "n"), ("f", "t"), ("t", "f"), ("ś", "5"), ("ż", "2"), ("ź", "2"), ("j", ";"), ("D", "0"),
]
#: Frequent words that the editor is trained on at most.
TRAINING_WORDS = 1_500
#: Share of true cuts that the editor's limit for line ends may lose, on cuts that it was not trained on.
JOINS_LOST = 0.0005
LINE_END = "\n"
#: Signs from which sequences of several edits are only the editor's best one.
LONG_WORD = 40
#: Words that one task of the editor takes, about.
EDITED = 2_000
#: Proposals that a worker holds at a time, about.
PROPOSED = 10_000
#: Words or lines, and documents as Python values, that a worker holds at a time. The batches that reach it hold up to 10,000 documents.
HELD = 10_000
DOCUMENTS = 20
MARKS = "-¬‐­=‑"
LETTERS = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźżäöüßé"
#: The usual tails of running headings (folded).
TAILS = ("umowa dostawy", "ogolne warunki sprzedazy", "karta gwarancyjna", "rozliczenie roczne", "dokumentacja zlecenia")
PAGE_NUMBER = re.compile(r"^\W*(?:(?:str(?:ona|\.)?|s\.?|page|seite|p\.)\W*)?(\d{1,4}|[lIiOo|])\W*(?:(?:z|/|of|von)\W*(?:\d{1,4}|[lIiOo|])\W*)?$", re.I)
HEADING = re.compile(r"^(.{2,}?)\s*(\||–|—|-|,)\s*([^|,]{4,}?)(\s{2,}\S{1,3})?$")
SOURCE = "record_table string, doc_id bigint, pages array<struct<page:int,lines:array<struct<item:int,text:string>>>>"


# --- The editor ----------------------------------------------------------------------------------------


class Editor:
    """Averaged perceptron over the signs of a word; labels are keep '', replacement texts, and '\\0' for delete."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self.options: dict[str, set[str]] = defaultdict(set)
        self.join_limit = float("-inf")

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        at = lambda j: word[j] if 0 <= j < len(word) else "^"
        c = at(i)
        return [f"0{c}", f"1{at(i - 1)}{c}", f"2{c}{at(i + 1)}", f"3{at(i - 1)}{c}{at(i + 1)}", f"4{at(i - 2)}{at(i - 1)}{c}", f"5{c}{at(i + 1)}{at(i + 2)}"]

    def state(self) -> tuple:
        return dict(self.w), {k: set(v) for k, v in self.options.items()}, self.join_limit

    @classmethod
    def of(cls, state: tuple) -> Editor:
        out = cls()
        out.w, out.options, out.join_limit = state
        return out

    def rank(self, word: str, i: int) -> list[tuple[float, str]]:
        fs = self.features(word, i)
        return sorted(((sum(self.w.get((f, y), 0.0) for f in fs), y) for y in self.options.get(word[i], {""}) | {""}), reverse=True)

    def fit(self, pairs: list[list[tuple[str, list[str]]]], rounds: int = 3) -> Editor:
        total: dict[tuple[str, str], float] = defaultdict(float)
        for word, labels in pairs:
            for c, y in zip(word, labels, strict=True):
                self.options[c].add(y)
        step = 0
        for _ in range(rounds):
            for word, labels in pairs:
                for i, y in enumerate(labels):
                    step += 1
                    guess = self.rank(word, i)[0][1]
                    if guess != y:
                        for f in self.features(word, i):
                            for label, d in ((y, 1.0), (guess, -1.0)):
                                self.w[f, label] += d
                                total[f, label] += d * step
        # The average over all steps is the last weight less the steps at which it was still unchanged.
        self.w = {k: v - total[k] / max(1, step) for k, v in self.w.items() if v or total[k]}
        return self

    def join_margin(self, a: str, mark: str, b: str) -> float:
        """How much better a join scores at the line end between two parts than a line end that stays."""
        text, at = a + mark + LINE_END + b, len(a) + len(mark)
        scores = {y: s for s, y in self.rank(text, at)}
        return scores.get("\0", 0.0) - scores.get("", 0.0)

    def proposals(self, word: str, most: int = 3) -> list[str]:
        """Words that edit sequences make of the word, the likeliest first.

        The best label of every place makes the first proposal. Then come all sequences of up to ``most``
        edits at any places, an edit being a replacement with the deletions that belong to it.
        """
        ranks = [dict((y, s) for s, y in self.rank(word, i)) for i in range(len(word))]
        best = [max(r, key=lambda y: (r[y], y == "")) for r in ranks]
        out = dict.fromkeys(["".join(c if y == "" else "" if y == "\0" else y for c, y in zip(word, best, strict=True))])
        most = most if len(word) <= LONG_WORD else 1
        edits = []
        for right, read in CONFUSIONS:
            at = word.find(read)
            while at >= 0:
                gain = ranks[at].get(right, -5.0) - ranks[at].get("", 0.0)
                gain += sum(ranks[at + k].get("\0", -5.0) - ranks[at + k].get("", 0.0) for k in range(1, len(read)))
                edits.append((at, at + len(read), right, gain / len(read)))
                at = word.find(read, at + 1)
        edits.sort()
        # Beginnings of the new word: (loss, the text so far, where the rest of the old word begins, the next edit to try).
        plans, begun = [], [(0.0, "", 0, 0)]
        for _ in range(most):
            begun = [(loss - gain, text + word[end:s] + right, e, k + 1) for loss, text, end, first in begun for k, (s, e, right, gain) in enumerate(edits[first:], first) if s >= end]
            plans += [(loss, text + word[end:]) for loss, text, end, _ in begun]
        out |= dict.fromkeys(new for _, new in sorted(plans) if new not in out)
        out.pop(word, None)
        return list(out)


def garble(word: str, r: random.Random, rate: float) -> tuple[str, list[str]]:
    """A misread form of a word with the labels that lead back."""
    out, labels, i = "", [], 0
    while i < len(word):
        fits = [(a, b) for a, b in CONFUSIONS if word.startswith(a, i)]
        if fits and r.random() < rate:
            right, read = r.choice(fits)
            out += read
            labels += [right, *["\0"] * (len(read) - 1)]
            i += len(right)
        elif out and labels[-1] == "" and r.random() < rate / 20:  # a lost sign: the one before it inserts it
            labels[-1] = out[-1] + word[i]
            i += 1
        else:
            out += word[i]
            labels.append("")
            i += 1
    return out, labels


def broken(word: str, r: random.Random) -> tuple[str, str, str]:
    """A word cut at a line end: first part, mark or none, second part."""
    at = r.randrange(2, len(word) - 1)
    return word[:at], r.choice(["", "", "-", "-", *MARKS]), word[at:]


def train(words: list[str], seed: int = 5) -> Editor:
    r = random.Random(seed)
    pairs, held = [], []
    for k, w in enumerate(words):
        pairs.append((w, [""] * len(w)))
        pairs += [garble(w, r, 0.12) for _ in range(2)] + [garble(w, r, 0.3)]
        if len(w) < 4:
            continue
        cuts = [broken(w, r) for _ in range(3)]
        if k % 5 == 4:
            held += cuts
            continue
        for a, mark, b in cuts:
            pairs.append((a + mark + LINE_END + b, [""] * len(a) + ["\0"] * (len(mark) + 1) + [""] * len(b)))
            other = r.choice(words)
            pairs.append((w + LINE_END + other, [""] * (len(w) + 1 + len(other))))
    r.shuffle(pairs)
    editor = Editor().fit(pairs)
    margins = sorted(editor.join_margin(*c) for c in held)
    if margins:
        editor.join_limit = margins[int(len(margins) * JOINS_LOST)] - 1e-9
    return editor


# --- Pages and lines -----------------------------------------------------------------------------------


def documents(ocr: DataFrame, boxes: DataFrame, results: DataFrame) -> DataFrame:
    """(record_table, doc_id, pages): all scanned text as pages of lines, grouped by document."""
    line = lambda item, text: F.transform(F.split(text, "\n"), lambda t: F.struct(item.cast("int").alias("item"), t.alias("text")))
    a = ocr.filter("text IS NOT NULL").select("doc_id", F.col("page_no").alias("page"), "text").dropDuplicates(["doc_id", "page"])
    a = a.select(F.lit("ocr_results").alias("record_table"), "doc_id", "page", line(F.col("page"), F.col("text")).alias("lines"))
    b = boxes.filter("text IS NOT NULL").select("doc_id", "box_id", F.col("page_no").alias("page"), "text").dropDuplicates(["doc_id", "box_id"])
    b = b.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct(F.col("box_id").cast("int").alias("item"), "text"))).alias("lines"))
    b = b.select(F.lit("text_boxes").alias("record_table"), "doc_id", "page", "lines")
    c = results.filter("source_type IN ('image', 'image_pdf') AND raw_text IS NOT NULL").select("doc_id", "raw_text").dropDuplicates(["doc_id"])
    c = c.select("doc_id", F.posexplode(F.split("raw_text", "\n\n")).alias("page", "text"))
    c = c.select(F.lit("extract_results").alias("record_table"), "doc_id", (F.col("page") + 1).alias("page"), line(F.lit(0), F.col("text")).alias("lines"))
    every = a.unionByName(b).unionByName(c)
    return every.groupBy("record_table", F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("page").cast("int").alias("page"), "lines"))).alias("pages"))


def _fold(text: str) -> str:
    return re.sub(r"[^a-z]", "", text.lower().translate(FOLD).translate(str.maketrans("01598@|", "olsgbal")))


def furniture(pages: list[tuple[int, list[str]]]) -> list[set[int]]:
    """Numbers of the lines of each page that are running headings or page numbers.

    What counts is the place: only the first and the last two lines of a page can be furniture, and a
    heading repeats on the other pages or looks like one of the usual headings.
    """
    tops = [next(((i, t) for i, t in enumerate(lines) if t.strip()), (-1, "")) for _, lines in pages]
    folded = [_fold(re.sub(r"\s{2,}\S{1,3}$", "", t.strip())) for _, t in tops]
    often = {f: sum(g == f for g in folded) for f in set(folded) if f} if len(folded) > 1 else {}
    common = [f for f, n in often.items() if n > 1]

    def repeats(p: int) -> bool:
        """Whether the first line of a page is also that of a page close by, or one with which several pages begin."""
        near = [folded[q] for q in range(max(0, p - 3), min(len(pages), p + 4)) if q != p and folded[q]]
        return often.get(folded[p], 0) > 1 or any(distance(folded[p], f, 5) <= 5 for f in [*near, *common])

    out = []
    for p, (page, lines) in enumerate(pages):
        found: set[int] = set()
        at, top = tops[p]
        m = HEADING.match(top.strip())
        if m and top.count("|") < 2 and ":" not in top:
            tail = _fold(m[3])
            usual = any(abs(len(tail) - len(_fold(u))) <= 4 and distance(tail, _fold(u), 4) <= 4 for u in TAILS)
            again = repeats(p)
            numbered = bool(m[4])
            if usual or again or (numbered and m[2] in "|–—"):
                found.add(at)
        elif at >= 0 and len(pages) > 1 and PAGE_NUMBER.match(top.strip()) and not top.strip().isdigit():
            found.add(at)
        elif at >= 0 and ":" not in top and top.count("|") < 2 and len(folded[p]) >= 8 and often.get(folded[p], 0) >= max(3, len(pages) / 2) and repeats(p):
            found.add(at)  # no sign parts it, but most pages begin with it
        filled = [i for i, t in enumerate(lines) if t.strip()]
        if len(filled) > 1 and (n := PAGE_NUMBER.match(lines[filled[-1]].strip())):
            bare = lines[filled[-1]].strip().isdigit()
            if not bare or int(n[1]) == page or int(n[1]) <= len(pages) + 1:
                found.add(filled[-1])
        out.append(found)
    return out


CORE = re.compile(rf"^[^\w@†|]*(.*?)[^\w@†|]*$", re.S)
MIXED = re.compile(rf"[{LETTERS}]")


def core(word: str) -> str:
    """The word without the punctuation around it; empty if it is no word to judge."""
    if re.search(r"https?:|www\.|\.(?:test|example|invalid|pl|com)\b|\S@\S+\.\S", word):
        return ""
    c = CORE.match(word)[1]
    letters = len(MIXED.findall(c))
    # Numbers, codes and account numbers are no words.
    if letters < 2 or len(re.findall(r"\d", c)) > max(2, letters) or re.fullmatch(r"[A-Z]{1,4}[-/_]?\d+.*|[A-Z]{2,3}", c) or re.search(r"\d{3}", c) or re.search(r"\d[.,/:]\d", c):
        return ""
    return c


def tokens_of(pages: list) -> Iterator[tuple]:
    """(item, page number, line number, number of the word, word, next word, previous word, next item, place) of the running text of a document's pages."""
    shaped = _shaped(pages)
    for number, ((_, lines), gone, p) in enumerate(zip(shaped, furniture(shaped), pages, strict=True)):
        items = [x["item"] for x in p["lines"]]
        kept = [i for i, t in enumerate(lines) if i not in gone and t.strip()]
        for k, i in enumerate(kept):
            if lines[i].count("|") >= 2:
                continue
            words = lines[i].split()
            after = kept[k + 1] if k + 1 < len(kept) and lines[kept[k + 1]].count("|") < 2 else None
            before = kept[k - 1] if k > 0 and lines[kept[k - 1]].count("|") < 2 else None
            for j, w in enumerate(words):
                place = "first" if j == 0 and k > 0 else "last" if j == len(words) - 1 and after is not None else "in"
                nxt = lines[after].split()[0] if j == len(words) - 1 and after is not None else None
                prev = lines[before].split()[-1] if j == 0 and before is not None else None
                yield items[i], number, i, j, w, nxt, prev, items[after] if nxt else None, place


def _shaped(pages: list) -> list[tuple[int, list[str]]]:
    return [(p["page"], [x["text"] or "" for x in p["lines"]]) for p in pages]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of Arrow batches, of which DOCUMENTS at a time become Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS):
            yield from batch.slice(at, DOCUMENTS).to_pylist()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many of the rows, which may come from a part of a document."""
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    """The Arrow schema of a few plain columns as Spark writes them."""
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


TOKENS = "record_table string, doc_id bigint, item int, page int, line int, at int, next_item int, place string, core string, a string, mark string, b string, pa string, pmark string, pb string"


def tokens(docs: DataFrame) -> DataFrame:
    """The words of the running text in their forms: the word to judge, the parts where a line end follows (a, mark, b) and where one precedes (pa, pmark, pb)."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cached, none = lru_cache(maxsize=200_000)(core), ("", "", "")
        for row in _rows(batches):
            for item, number, i, j, w, nxt, prev, next_item, place in tokens_of(row["pages"]):
                cutting = (_meet(w, nxt) if nxt is not None else None) or none
                cut_by = (_meet(prev, w) if prev is not None else None) or none
                yield row["record_table"], row["doc_id"], item, number, i, j, next_item, place, cached(w), *cutting, *cut_by

    return docs.mapInArrow(lambda batches: _batches(forms(batches), _arrow(TOKENS)), TOKENS)


def furniture_lines(docs: DataFrame) -> DataFrame:
    """(record_table, doc_id, item, page, line, text) of the lines that are furniture."""

    schema = "record_table string, doc_id bigint, item int, page int, line int, text string"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in _rows(batches):
            for number, (gone, p) in enumerate(zip(furniture(_shaped(row["pages"])), row["pages"], strict=True)):
                for i in sorted(gone):
                    yield row["record_table"], row["doc_id"], p["lines"][i]["item"], number, i, p["lines"][i]["text"]

    return docs.mapInArrow(lambda batches: _batches(lines(batches), _arrow(schema)), schema)


def _meet(word: str, following: str) -> tuple[str, str, str] | None:
    """(first part, mark, second part) where a line end may cut a word."""
    m = re.match(rf"^[^\w@†]*([\w@†|;-]*?[\w@†|])([{MARKS}]?)$", word)
    q = re.match(r"^([\w@†|;-]*[\w@†|])", following)
    if m and q and (MIXED.search(m[1][-1]) or m[1][-1] in "01259@†") and MIXED.search(m[1]) and (MIXED.search(q[1][0]) or q[1][0] in "01259@†") and MIXED.search(q[1]):
        return m[1], m[2], q[1]
    return None


ODD = rf"[{LETTERS}][0-9@†|][{LETTERS}]|^[0-9@†|][{LETTERS}]{{2,}}|[{LETTERS}]{{2,}}[0-9@†|]$|[†@]|[{LETTERS}][0-9]{{1,2}}[{LETTERS}]"


def learnt(counts: DataFrame) -> Editor:
    """The editor trained on the commonest words, at most TRAINING_WORDS."""
    sample = counts.filter(F.col("word").rlike(rf"^[{LETTERS}]{{3,}}$")).orderBy(F.desc("n"), "word").limit(TRAINING_WORDS)
    return train([r["word"] for r in sample.filter("n >= 3").collect()])


def edits(counts: DataFrame, editor: Editor) -> DataFrame:
    """(word, fixed): misread words with what they most likely are."""
    sent = counts.sparkSession.sparkContext.broadcast(editor.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Editor.of(sent.value)
        for pdf in batches:
            out: list[tuple] = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                out += [(word, n, f, k) for k, f in enumerate(mine.proposals(word))]
                if len(out) >= PROPOSED:
                    yield pd.DataFrame(out, columns=["word", "n", "fixed", "rank"])
                    out = []
            yield pd.DataFrame(out, columns=["word", "n", "fixed", "rank"])

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine, odd = Editor.of(sent.value), re.compile(ODD)
        for pdf in batches:
            rows = [(w, next((f for f in mine.proposals(w) if not odd.search(f)), None)) for w in pdf["word"]]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["word", "fixed"])

    # A word is judged in the case it has and, when it begins a sentence, as the small word too.
    rare = counts.filter(F.length("word") >= 3)
    cores = counts.sparkSession.sparkContext.defaultParallelism
    tasks = max(2 * cores, counts.count() // EDITED)
    proposed = rare.repartition(tasks, "word").mapInPandas(run, "word string, n bigint, fixed string, rank int")
    low = counts.groupBy(F.lower("word").alias("low")).agg(F.sum("n").alias("m"))
    met = proposed.join(low, F.lower("fixed") == F.col("low")).filter("m >= 4 AND m >= 12 * n")
    own = counts.groupBy(F.lower("word").alias("own")).agg(F.sum("n").alias("seen"))
    met = met.join(own, F.lower("word") == F.col("own")).filter("m >= 12 * seen")
    known = cut(met.groupBy("word").agg(F.max_by("fixed", F.struct("m", -F.col("rank"))).alias("fixed")), "scan-known")
    odd = rare.filter(F.col("word").rlike(ODD)).join(known, "word", "left_anti").select("word")
    return known.unionByName(odd.repartition(cores, "word").mapInPandas(best, "word string, fixed string"))


def proposed_joins(pairs: DataFrame, editor: Editor) -> DataFrame:
    """The line ends (a, mark, b) at which the editor does not rule out a join."""
    sent = pairs.sparkSession.sparkContext.broadcast(editor.state())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = Editor.of(sent.value)
        for pdf in batches:
            yield pdf[[mine.join_margin(a, m, b) >= mine.join_limit for a, m, b in zip(pdf["a"], pdf["mark"], pdf["b"], strict=True)]]

    return pairs.mapInPandas(run, "a string, mark string, b string")



def analysed(docs: DataFrame, places: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens with their forms, misread words with fixes, line ends that cut a word); without ``places`` the tokens have no place in the line."""
    words = tokens(docs)
    words = cut(words if places else words.drop("page", "line", "at"), "scan-words")
    inside = words.filter("place = 'in' AND core <> ''").groupBy(F.col("core").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    inside = cut(inside, "scan-inside")
    low = inside.groupBy(F.lower("word").alias("w")).agg(F.sum("n").alias("n"))
    ends = words.filter("a <> '' AND b <> ''")
    editor = learnt(inside)
    pairs = proposed_joins(ends.select("a", "mark", "b").distinct(), editor)
    for name, form in (("whole", F.concat("a", "b")), ("compound", F.concat_ws("-", "a", "b")), ("left", F.col("a")), ("right", F.col("b"))):
        pairs = pairs.join(low.select(F.col("w").alias(f"w_{name}"), F.col("n").alias(name)), F.lower(form) == F.col(f"w_{name}"), "left").drop(f"w_{name}")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    small = F.col("b").rlike(r"^[a-ząćęłńóśźż0-9@†]")
    plain = (F.col("mark") == "-") | (F.col("mark") == "‑")
    joined = F.when(n("whole") > 0, n("whole") >= n("compound")).otherwise((n("compound") == 0) & ~_compound_part(F.col("a")))
    marked = F.when(plain, joined & small).otherwise((F.col("mark") != "") & small)
    unmarked = (F.col("mark") == "") & small & (n("whole") >= 3) & ((n("left") * 50 < n("whole")) | (n("right") * 50 < n("whole")))
    cuts = cut(pairs.filter(marked | unmarked).select("a", "b", "mark"), "scan-cuts")
    # Words to judge: those that no line end cuts, and the wholes of those that one does.
    here = words.join(cuts.withColumn("cuts", F.lit(True)), ["a", "b", "mark"], "left")
    after = cuts.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("mark").alias("pmark"), F.lit(True).alias("cut_by"))
    here = here.join(after, ["pa", "pb", "pmark"], "left")
    judged = F.when(F.col("cuts"), F.concat("a", "b")).when(F.col("cut_by"), F.lit("")).otherwise(F.col("core"))
    words = cut(here.withColumn("judged", judged).withColumn("joins", F.coalesce("cuts", F.lit(False))).drop("cuts", "cut_by", "core", "mark", "pa", "pmark", "pb", "place"), "scan-judged")
    anywhere = cut(words.filter("judged <> ''").groupBy(F.col("judged").alias("word")).agg(F.count(F.lit(1)).alias("n")), "scan-counts")
    return words, cut(edits(anywhere, editor), "scan-fixes"), cuts


def _compound_part(a):
    """First parts that Polish joins to the next with a hyphen of its own end in -o; the corpus decides the rest."""
    return a.rlike(r"(?:owo|czno|lno|nio|czo|ało|ółto|wno|dno|sko)$") & (F.length("a") >= 5)


def found(ocr: DataFrame, boxes: DataFrame, results: DataFrame) -> DataFrame:
    docs = cut(documents(ocr, boxes, results), "scan-docs")
    words, fixes, cuts = analysed(docs, places=False)
    key = ["record_table", "doc_id", "item"]
    bad = words.filter("judged <> ''").join(fixes.withColumnRenamed("word", "judged"), "judged")
    # In a cut word the half that changes holds the misread sign.
    whole_first = F.col("fixed").startswith(F.col("a")) & (F.col("fixed") != F.col("judged"))
    item = F.when(F.col("joins") & whole_first, F.col("next_item")).otherwise(F.col("item"))
    misread = bad.select("record_table", "doc_id", item.alias("item"), F.lit("misread").alias("kind"))
    hyphen = words.filter("joins").select(*key, F.lit("hyphenation").alias("kind"))
    page = furniture_lines(docs).select(*key, F.lit("page_furniture").alias("kind"))
    return misread.unionByName(hyphen).unionByName(page).distinct()


def repaired(ocr: DataFrame, boxes: DataFrame, results: DataFrame) -> DataFrame:
    """(record_table, doc_id, text): every document as paragraphs, without furniture, cut words joined and misread words repaired."""
    docs = cut(documents(ocr, boxes, results), "scan-docs")
    words, fixes, cuts = analysed(docs)
    w = words.join(fixes.withColumnRenamed("word", "judged"), "judged", "left")
    changed = w.filter("joins OR (fixed IS NOT NULL AND fixed <> judged)")
    notes = changed.groupBy("record_table", "doc_id").agg(F.collect_list(F.struct("page", "line", "at", "judged", "fixed", "joins", "a", "b")).alias("notes"))

    schema = "record_table string, doc_id bigint, text string"

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for row in _rows(batches):
            by = {(x["page"], x["line"], x["at"]): x for x in row["notes"] or []}
            shaped = _shaped(row["pages"])
            whole = []
            for number, ((_, lines), gone) in enumerate(zip(shaped, furniture(shaped), strict=True)):
                width = max((len(t) for t in lines), default=0)
                text, carried = "", None
                for i, t in enumerate(lines):
                    if i in gone or not t.strip():
                        continue
                    if t.count("|") >= 2:
                        text += ("\n" if text else "") + t.strip() + "\n"
                        continue
                    parts, joined = t.split(), False
                    if carried is not None:  # the second half of a word that the line before began
                        rest = parts[0][len(carried) :] if parts[0].startswith(carried) else ""
                        text, parts = text + rest + (" " if len(parts) > 1 else ""), parts[1:]
                        carried = None
                        shift = 1
                    else:
                        shift = 0
                    for j, word in enumerate(parts):
                        x = by.get((number, i, j + shift))
                        if x is None:
                            continue
                        new = x["fixed"] or x["judged"]
                        if x["joins"]:
                            head = word[: word.find(x["a"])] if x["a"] in word else ""
                            parts[j], carried, joined = head + new, x["b"], True
                        else:
                            parts[j] = word.replace(x["judged"], new)
                    text += " ".join(parts)
                    short = len(t) < 0.6 * width and not joined
                    joined = joined or bool(re.search(r"\w-$", t.strip()))  # a compound keeps its hyphen
                    text += "" if joined else "\n" if short and re.search(r"[.:;!?\d]$", t.strip()) else " "
                whole.append(re.sub(r"[ \n]*\n[ \n]*", "\n", text).strip())
            yield row["record_table"], row["doc_id"], "\n\n".join(whole)

    return docs.join(notes, ["record_table", "doc_id"], "left").mapInArrow(lambda batches: _batches(texts(batches), _arrow(schema), DOCUMENTS), schema)
