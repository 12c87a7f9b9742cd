"""Variant spellings of the names of organisations and people, linked to entities.

* Parsing: a name is folded (letter case, accents, quotes) and its parts are told by patterns and word
  lists: kind of business, line of business, legal form, title, first name (also as nickname or initial);
  an abbreviation or a misspelling of a role's word counts as the word. What no role takes is the core (the
  made-up part or the surname), which may be one token or several, in any order, or a word typed in pieces.
* Symmetric-delete index on tokens: every distinct core emits, for each of its tokens, the strings left when
  up to two signs of it are deleted, beside its other tokens in sorted order; and the same for all tokens
  written as one word. No key is common, since the other tokens stand in it. Tokens of over LONG signs emit
  the pieces of which one must be intact instead.
* Verification: two cores that meet are compared by the cheapest assignment of the tokens of one to those of
  the other (short forms, initials and edits have a cost). Tokens in another order link; one edit or
  exchange of neighbours links if the one spelling is rare beside the other; two edits link a long core that
  is much rarer; what else is known of the two must not disagree. Components of the links get the smallest
  core as their root, by labels that travel along the links, without pairs inside a group.
* Resolution inside a root: people by first name, an initial or nickname joins the only first name it can
  stand for; firms by line of business, a name without it joins the only firm it agrees with (kind, form,
  tax number and town decide where several share the core).

Defined cases: null, empty and placeholder names denote nobody; repeated rows of a party count once; a
name of known words only (no core) denotes nobody; ties go to the smaller text; an empty table gives no
rows; further columns are ignored. Pairs are formed from classes only at the end; ``classes`` gives one
row per party instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

FOLD = str.maketrans("ąćęłńóśźżäöüßéè", "acelnoszzaousee")

#: Kinds of business with their usual abbreviations (folded).
KINDS = {
    "firma handlowa": ["fh", "f h", "firma handl"],
    "biuro rachunkowe": ["br", "b r", "biuro rach"],
    "hurtownia": ["hurt"],
    "zaklady mechaniczne": ["zm", "z m", "zakl mech", "zaklad mechaniczny"],
    "zaklad uslug technicznych": ["zut", "z u t", "zakl usl techn"],
    "spoldzielnia pracy": ["sp nia pracy", "spoldz pracy", "sp nia p", "s p"],
    "przedsiebiorstwo handlowo uslugowe": ["phu", "p h u", "przeds handl usl"],
    "przedsiebiorstwo produkcyjno handlowe": ["pph", "p p h", "przeds prod handl"],
}
#: Lines of business (folded); an abbreviation is a beginning of three letters or more.
LINES = "stal pasze drewno serwis logistyka opakowania poligrafia chemia oprogramowanie tekstylia meble ogrody transport energia elektronika budownictwo".split()
LINE_SHORT = {"drew": "drewno", "trans": "transport", "oprogr": "oprogramowanie", "elektr": "elektronika", "energ": "energia"}
#: Legal forms as patterns over the folded name without dots.
FORMS = (
    ("zoo", r"\b(?:sp(?:olka)?) ?z ?o ?o\b|\bspolka z o ?o\b|\bsp(?:olka)? z ogr(?:aniczona)? odp(?:owiedzialnoscia)?\b"),
    ("j", r"\bsp(?:olka)? ?j(?:awna)?\b"),
    ("k", r"\bsp(?:olka)? ?k(?:omandytowa)?\b"),
    ("c", r"\bs ?c\b|\bspolka cywilna\b"),
    ("a", r"\bs ?a\b|\bspolka akcyjna\b"),
)
#: First names with their usual short forms (folded).
FIRST = {
    "agnieszka": "aga agusia", "bartosz": "bartek bobek bartus", "cezary": "czarek", "dorota": "dora dorotka", "elzbieta": "ela elka", "franciszek": "franek",
    "grzegorz": "grzesiek grzes", "henryk": "heniek", "iwona": "iwonka", "joanna": "asia joasia", "katarzyna": "kasia kaska", "lukasz": "lukaszek",
    "malgorzata": "gosia malgosia", "natalia": "natalka", "olga": "ola olenka", "pawel": "pawelek", "robert": "robus", "stanislaw": "staszek stach",
    "tadeusz": "tadek", "urszula": "ula ulka", "wojciech": "wojtek wojtus", "zofia": "zosia", "krzysztof": "krzysiek", "andrzej": "andrzejek", "tomasz": "tomek",
    "barbara": "basia", "magdalena": "magda", "zbigniew": "zbyszek", "ryszard": "rysiek",
}
#: Further first names (folded), known only in full.
OTHER_FIRST = """adam adrian alicja aleksander aleksandra andrzej aneta anna antoni arkadiusz artur barbara beata bogdan bozena daniel danuta dariusz dominik edward emilia ewa ewelina filip gabriela halina hanna helena
    irena izabela jacek jadwiga jakub jan janina janusz jaroslaw jerzy jozef jolanta julia justyna kamil karol karolina kinga klaudia konrad krystyna krzysztof leszek magdalena maciej marcin marek maria marian mariusz
    marta mateusz michal miroslaw monika norbert patryk paulina piotr przemyslaw rafal renata roman ryszard sebastian slawomir sylwia szymon teresa tomasz wanda weronika wieslaw witold wladyslaw zbigniew zdzislaw zygmunt""".split()
TITLES = {"mgr", "inz", "pan", "pani", "dr", "prof"}
#: What stands for a missing name.
NOBODY = {"", "brak", "nd", "n d", "nie dotyczy", "none", "null", "nn", "x", "xx", "xxx", "test", "brak danych", "nieznany", "bd", "b d", "anonim", "do uzupelnienia"}
COMPOUND = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)+")
SURNAME = re.compile(r"(?:sk|ck|dzk)[iae]$|(?:czak|wicz|niak|czyk)$")

NAME_OF = {short: name for name, shorts in FIRST.items() for short in [name, *shorts.split()]}


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between two words, an exchange of neighbours counting as one; most + 1 when there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        last, row = row, [i]
        for j, y in enumerate(b, start=1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before = last
    return row[-1]


@lru_cache(maxsize=100_000)
def near(word: str, options: tuple[str, ...], most: int = 1) -> str | None:
    """The one option that the word misspells, the nearest and then first one."""
    best = min(((distance(word, o, most), o) for o in options if abs(len(o) - len(word)) <= most), default=(most + 1, ""))
    return best[1] if best[0] <= most else None


_KIND_WORDS = sorted(((re.compile(rf"\b{p}\b"), k) for k, shorts in KINDS.items() for p in [k, *shorts]), key=lambda x: -len(x[0].pattern))
_FORM_WORDS = [(f, re.compile(p)) for f, p in FORMS]
_KNOWN = tuple(sorted({w for k in KINDS for w in k.split() if len(w) > 4} | {"spolka", "ograniczona", "odpowiedzialnoscia", "akcyjna", "jawna", "komandytowa", "cywilna"}))
_FIRSTS = tuple(sorted(NAME_OF))
NAME_OF |= {name: name for name in OTHER_FIRST if name not in NAME_OF}
EMPTY = ("nobody", None, None, None, None, None, None)


def line_of(token: str) -> str | None:
    if token in LINE_SHORT:
        return LINE_SHORT[token]
    if len(token) >= 3:
        for w in LINES:
            if w.startswith(token):
                return w
    return None


def parse(name: str | None) -> tuple:
    """(what, core, kind, line, form, first, words) of a name; what is 'firm', 'person' or 'nobody', an initial is a first of one letter, words are the tokens of the core."""
    text = (name or "").lower().translate(FOLD)
    text = re.sub(r"[\"'„”“’`«»]", "", text)
    hyphen = re.search(r"\w-\w", text)
    compound = {t for m in COMPOUND.finditer(text) for t in m[0].split("-")}
    flat = re.sub(r"[^a-z0-9]+", " ", text).strip()
    if flat in NOBODY or not re.search("[a-z]", flat):
        return EMPTY
    kind = line = form = None
    for f, pattern in _FORM_WORDS:
        if pattern.search(flat):
            form, flat = f, pattern.sub(" ", flat, count=1)
            break
    for pattern, k in _KIND_WORDS:
        if pattern.search(flat):
            kind, flat = k, pattern.sub(" ", flat, count=1)
            break
    tokens = [t for t in flat.split() if t not in TITLES]
    rest = []
    for t in tokens:
        # Half of a word with a hyphen is no abbreviation of a line of business.
        found = line_of(t) if line is None and len(tokens) > 1 and (t in LINES or t not in compound) else None
        if found:
            line = found
        else:
            rest.append(t)
    # Misspelt words of a role leave the core as soon as something else can be the core.
    for at in range(len(rest) - 1, -1, -1):
        if len(rest) < 2:
            break
        t = rest[at]
        if len(t) >= 5 and near(t, _KNOWN) or t in ("spolka", "sp", "z", "oo") and len(rest) > 2:
            rest.pop(at)
        elif line is None and len(t) >= 4 and near(t, tuple(LINES)):
            line = near(t, tuple(LINES))
            rest.pop(at)
    if not rest:
        return EMPTY
    if form is None and kind is None and line is None or any(SURNAME.search(t) for t in rest):
        first = None
        if len(rest) >= 3 and "p" in rest:  # short for a form of address
            rest.remove("p")
        if len(rest) >= 2:
            for at, t in enumerate(rest):
                if t in NAME_OF:
                    first = NAME_OF[t]
                elif len(t) == 1:
                    first = t
                else:
                    continue
                rest.pop(at)
                break
            else:
                close = [(distance(t, c), at, c) for at, t in enumerate(rest) if len(t) >= 3 and (c := near(t, _FIRSTS, 2 if len(t) >= 7 else 1))]
                if close:
                    _, at, c = min(close)
                    first = NAME_OF[c]
                    rest.pop(at)
        if first and form is None and kind is None and line is None:
            return ("person", "".join(rest), None, None, None, first, " ".join(rest))
        if first:
            rest.append(first) if len(first) > 1 else None
    if len(rest) > 1 and not hyphen:  # letters of an unknown abbreviation beside a long core
        longer = [t for t in rest if len(t) > 2]
        if longer and sum(map(len, longer)) >= 6:
            rest = longer
    core = "".join(rest)
    return ("firm", core, kind, line, form, None, " ".join(rest)) if len(core) > 1 else EMPTY


def parsed(parties: DataFrame) -> DataFrame:
    """Distinct names with their parts: name, what, core, kind, line, form, first, words."""
    names = parties.select("name").filter(F.col("name").isNotNull()).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame([parse(n) for n in pdf["name"]], columns=["what", "core", "kind", "line", "form", "first", "words"])
            out.insert(0, "name", pdf["name"].to_numpy())
            yield out[out["what"] != "nobody"]

    return names.mapInPandas(run, "name string, what string, core string, kind string, line string, form string, first string, words string")


#: Cost of aligning a token with its short form, with an initial, and per edit; more than LIMIT in all is no match.
SHORT, INITIAL, EDIT, LIMIT = 0.1, 0.2, 0.3, 0.9
#: How many times oftener a core is than the spellings of two edits that several typed alike.
RARER = 8


def token_cost(a: str, b: str) -> float:
    """Cost of taking two tokens for the same word; 1 or more if they are not."""
    if a == b:
        return 0.0
    if NAME_OF.get(a, a) == NAME_OF.get(b, b):
        return SHORT
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return INITIAL if long.startswith(short) else 1.0
    if len(short) >= 3 and long.startswith(short):
        return SHORT
    d = distance(a, b)
    return EDIT * d if d <= (2 if len(short) >= 8 else 1) else 1.0


def align(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Least cost of assigning the tokens of the shorter name to different tokens of the longer one.

    A dynamic program over the sets of used tokens; names have a handful of tokens. Tokens that only one
    name has are missing parts and cost nothing.
    """
    if len(a) > len(b):
        a, b = b, a
    best = {0: 0.0}
    for x in a:
        step: dict[int, float] = {}
        for used, cost in best.items():
            for j, y in enumerate(b):
                if not used >> j & 1:
                    key, new = used | 1 << j, cost + token_cost(x, y)
                    if new < step.get(key, 99.0):
                        step[key] = new
        best = step
    return min(best.values(), default=0.0)


#: Signs of a token from which pieces take the place of deletions, whose number grows with the square of its length.
LONG = 40


def deletions(word: str) -> set[str]:
    """Keys of which words within two edits share one: the word without up to two of its signs (one in a short word).

    Words of over LONG signs have the pieces that two edits leave intact instead; those about that long have both.
    """
    n = len(word)
    keys: set[str] = set()
    if n <= LONG + 2:
        most = 2 if n >= 8 else 1 if n >= 4 else 0
        keys = {"".join(c for i, c in enumerate(word) if i not in gone) for k in range(most + 1) for gone in combinations(range(n), k)}
    if n > LONG - 2:
        keys |= pieces(word)
    return keys


def pieces(word: str, parts: int = 5, most: int = 2) -> set[str]:
    """The fifths of a word, and what may be a fifth of a word that is at most two edits away, each with its number and the word's length.

    Two edits, an exchange at a border among them, touch at most four of five pieces, and shift the fifth by at most two.
    """
    out = set()
    for size in range(len(word) - most, len(word) + most + 1):
        bounds = [size * k // parts for k in range(parts + 1)]
        for k in range(parts):
            for shift in range(-most, most + 1):
                at = bounds[k] + shift
                if at >= 0 and at + bounds[k + 1] - bounds[k] <= len(word):
                    out.add(f"{size}/{k}/{word[at : at + bounds[k + 1] - bounds[k]]}")
    return out


def keys_of(words: str) -> set[str]:
    """The index keys of the tokens of a core: each token's deletions beside the other tokens."""
    tokens = words.split(" ")
    return {" ".join([*sorted(tokens[:i] + tokens[i + 1 :]), "|" + d]) for i, t in enumerate(tokens) for d in deletions(t)}


def tokens_apart(a: str, b: str) -> int:
    """Edits between the tokens of two cores under their cheapest assignment; 3 if they do not match."""
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return distance(a.replace(" ", ""), b.replace(" ", ""))
    best = {0: 0}
    for t in x:
        step: dict[int, int] = {}
        for used, d in best.items():
            for j, u in enumerate(y):
                if not used >> j & 1 and (new := d + distance(t, u)) < step.get(used | 1 << j, 3):
                    step[used | 1 << j] = new
        best = step
    return min(best.values(), default=3)


FACTS = ["kind", "line", "form", "first", "city"]


def core_roots(cores: DataFrame) -> DataFrame:
    """(what, core, root) from (what, core, n, words and the sets of FACTS): misspelt cores point to the core they most likely stand for."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, c, n, forms in zip(pdf["what"], pdf["core"], pdf["n"], pdf["words"], strict=True):
                # All tokens as one word, since a word may be typed in pieces; then the tokens.
                rows += [(w, c, n, c, f"|{d}") for d in deletions(c)]
                rows += [(w, c, n, f, k) for f in forms if " " in f for k in keys_of(f)]
            yield pd.DataFrame(rows, columns=["what", "core", "n", "tokens", "part"])

    index = cut(cores.select("what", "core", "n", "words").mapInPandas(emit, "what string, core string, n bigint, tokens string, part string"), "deletes")
    a, b = index.alias("a"), index.alias("b")
    more = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.core") < F.col("a.core")))
    close = F.levenshtein(F.col("a.core"), F.col("b.core"), 3)  # an exchange of neighbours counts as two here
    several = F.col("a.tokens").contains(" ") & F.col("b.tokens").contains(" ")
    # A core that was typed alike by several is no misspelling of two edits, nor one edit from an equal.
    likely = (F.col("a.n") <= 2) | (F.col("b.n") >= 3 * F.col("a.n")) | several
    met = (
        a.join(b, (F.col("a.what") == F.col("b.what")) & (F.col("a.part") == F.col("b.part")) & more & likely)
        .filter(several | (close >= 0) & ((close <= 2) | (F.length("a.core") >= 9)))
        .select("a.what", "a.core", F.col("a.n").alias("n"), F.col("b.core").alias("to"), F.col("b.n").alias("m"), F.col("a.tokens").alias("own"), F.col("b.tokens").alias("other"))
        .distinct()
    )
    mine = cores.select("what", "core", *[F.col(c).alias(f"my_{c}") for c in FACTS])
    theirs = cores.select("what", F.col("core").alias("to"), *[F.col(c).alias(f"to_{c}") for c in FACTS])
    met = met.join(mine, ["what", "core"]).join(theirs, ["what", "to"])
    agree = F.lit(True)
    for c in FACTS:
        one, other = F.col(f"my_{c}"), F.col(f"to_{c}")
        if c == "first":  # an initial agrees with every name that begins so
            one, other = [F.array_distinct(F.transform(x, lambda f: F.substring(f, 1, 1))) for x in (one, other)]
        met_fact = (F.size(one) == 0) | (F.size(other) == 0) | F.arrays_overlap(one, other)
        agree = agree & (met_fact if c != "city" else F.lit(True))
        met = met.withColumn(f"ok_{c}", met_fact)
    # The tokens beside the core: of each role that both sides fill, a token they share, or the only ones they have.
    def tokens(side: str):
        out = []
        for c in ("kind", "line", "first"):
            common = F.array_min(F.array_intersect(f"my_{c}", f"to_{c}"))
            single = (F.size(f"my_{c}") == 1) & (F.size(f"to_{c}") == 1)
            out.append(F.coalesce(common, F.when(single, F.get(f"{side}_{c}", F.lit(0)))))
        return F.array_compact(F.array(*out))

    met = met.filter(agree).select("what", "core", "n", "to", "m", "own", "other", "ok_city", tokens("my").alias("mine"), tokens("to").alias("theirs"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = np.array([tokens_apart(x, y) for x, y in zip(pdf["own"], pdf["other"], strict=True)], dtype=np.int32)
            cost = [align((*x.split(" "), *a), (*y.split(" "), *b)) for x, y, a, b in zip(pdf["own"], pdf["other"], pdf["mine"], pdf["theirs"], strict=True)]
            yield pdf.assign(d=d, cost=cost)[lambda p: (p["d"] <= 2) & (p["cost"] <= LIMIT)].drop(columns=["mine", "theirs", "own", "other"])

    edges = met.mapInPandas(verify, "what string, core string, n bigint, to string, m bigint, ok_city boolean, d int, cost double")
    rare = (F.col("n") <= 2) | (F.col("m") >= 3 * F.col("n"))
    rarer = (F.col("n") == 1) | (F.col("m") >= RARER * F.col("n"))
    edges = edges.filter((F.col("d") == 0) | (F.col("d") == 1) & rare | (F.col("d") == 2) & rarer & F.col("ok_city") & (F.length("core") >= 9))
    edges = cut(edges.groupBy("what", "core", "to").agg(F.min("d").alias("d")), "edges")
    # Two edits count only for a core that has no neighbour at one.
    near_by = edges.filter("d <= 1").select("what", "core").distinct()
    edges = edges.filter("d <= 1").unionByName(edges.filter("d = 2").join(near_by, ["what", "core"], "left_anti"))
    return cores.join(components(edges.select("what", "core", "to")), ["what", "core"], "left").select("what", "core", F.coalesce("root", "core").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(what, core, root) for every core with an edge: the smallest core of its component.

    The smallest label travels along the edges, and each round also jumps to the label of the label, so
    the rounds grow with the logarithm of the longest chain of misspellings.
    """
    both = cut(edges.unionByName(edges.select("what", F.col("to").alias("core"), F.col("core").alias("to"))).distinct(), "both")
    labels = cut(both.groupBy("what", "core").agg(F.least("core", F.min("to")).alias("root")), "labels")
    while True:
        theirs = labels.select("what", F.col("core").alias("to"), F.col("root").alias("other"))
        least = both.join(theirs, ["what", "to"]).groupBy("what", "core").agg(F.min("other").alias("other"))
        far = labels.select("what", F.col("core").alias("root"), F.col("root").alias("far"))
        new = labels.join(least, ["what", "core"]).join(far, ["what", "root"], "left").withColumn("next", F.least("root", "other", "far"))
        moved = cut(new.select("what", "core", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "labels")
        labels = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return labels


SIGN = ["what", "root", "kind", "line", "form", "first", "city", "nip"]


#: Signature rows that one group of roots holds on average.
GROUP_ROWS = 5_000


def resolve(rows: list[dict]) -> list[str]:
    """The entity label of each signature row of one root."""
    if rows[0]["what"] == "person":
        full = sorted({r["first"] for r in rows if len(r["first"]) > 1})
        out = []
        for r in rows:
            f = r["first"]
            if len(f) > 1:
                out.append(f)
                continue
            options = [g for g in full if g[0] == f]
            if len(options) > 1 and r["city"] is not None:
                same = sorted({q["first"] for q in rows if q["first"] in options and q["city"] == r["city"]})
                options = same if len(same) == 1 else options
            out.append(options[0] if len(options) == 1 else f)
        return out
    lines = sorted({r["line"] for r in rows if r["line"] is not None})
    if len(lines) <= 1:
        return ["firm"] * len(rows)
    order = ("nip", "city", "kind", "form")
    facts = {x: {c: {r[c] for r in rows if r["line"] == x and r[c] is not None} for c in order} for x in lines}
    out = []
    for r in rows:
        if r["line"] is not None:
            out.append(r["line"])
            continue
        options, pick = lines, None
        for c in order:
            if r[c] is None:
                continue
            agree = [x for x in options if r[c] in facts[x][c]]
            if len(agree) == 1:
                pick = agree[0]
                break
            options = agree or options
        out.append(pick or "none")
    return out


def classes(parties: DataFrame) -> DataFrame:
    """(party_id, entity): one row per party whose name denotes somebody."""
    # One record per party: repeated rows are the same record.
    rows = parties.select(F.col("party_id").cast("bigint").alias("party_id"), "name", F.lower(F.trim("city")).alias("city"), F.regexp_replace("nip", "[^0-9]", "").alias("nip")).distinct()
    names = cut(parsed(rows), "names")
    known = cut(rows.join(names, "name").drop("name"), "known")
    cores = known.groupBy("what", "core").agg(F.count_distinct("party_id").alias("n"), F.collect_set("words").alias("words"), *[F.collect_set(c).alias(c) for c in FACTS])
    roots = core_roots(cut(cores, "cores"))
    placed = cut(known.join(roots, ["what", "core"]), "placed")
    signs = cut(placed.select(*SIGN).distinct(), "signs")
    groups = max(1, signs.count() // GROUP_ROWS)
    names_of = [*SIGN, "entity"]

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        by_root: dict[tuple, list[dict]] = {}
        for r in pdf[SIGN].astype(object).where(pdf[SIGN].notna(), None).to_dict("records"):
            by_root.setdefault((r["what"], r["root"]), []).append(r)
        out = [(*r.values(), f"{w}|{root}|{e}") for (w, root), rows in by_root.items() for r, e in zip(rows, resolve(rows), strict=True)]
        return pd.DataFrame(out, columns=names_of)

    found = signs.withColumn("group", F.pmod(F.xxhash64("what", "root"), F.lit(groups))).groupBy("group").applyInPandas(many, ", ".join(f"{c} string" for c in names_of))
    on = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) for c in SIGN]
    return placed.alias("p").join(found.alias("f"), on).select("p.party_id", "f.entity").distinct()


def pairs(members: DataFrame, key: str, group: str) -> DataFrame:
    """All pairs of different members of a class, smaller first."""
    a, b = members.select(group, F.col(key).alias(f"{key}_a")), members.select(group, F.col(key).alias(f"{key}_b"))
    return a.join(b, group).filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()


def found(parties: DataFrame) -> DataFrame:
    return pairs(cut(classes(parties), "entities"), "party_id", "entity")
