"""Address records that denote the same place: set-containment join over canonical parts.

* Parsing: street, postal code, city and raw text are read as one; the house number with its letter and the
  flat, the postal code, the town and the street come out wherever they stand.
* Canonical parts: towns are matched to the towns of the postal-code table (a fixed reference table whose
  size is checked before it goes to the workers), else taken from the postal code; a street name that is
  rare is replaced by a much commoner one at most two edits away, found by a symmetric-delete index.
* Containment join: every distinct record is a set of elements (its street, and its town, given name and both
  with the street; each beside house and flat, so that no element is common). It is indexed by its rarest
  element; fuller records probe with all of theirs; a pair is verified by weighted containment (elements weigh
  by their rarity, CONTAINED of the lesser record's weight must be met) and by the absence of contradictions:
  another house, flat, town or given name, or, where a record names no town, postal codes of other districts.
  A record joins the one place that contains it; a record that several places contain joins none.

Defined cases: a record without street or without house number denotes no place; house letters ignore case;
no flat and a flat differ; an unknown town (neither named nor by postal code) joins only if one place fits;
repeated rows count once; null and empty parts are missing parts; an empty table gives no rows; further
columns are ignored. Pairs are formed from classes at the end; ``places`` has one row per record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .names import FOLD, deletions, distance, pairs

#: Most rows of the postal-code reference, which is sent to the workers; a larger table is refused.
REFERENCE_ROWS = 200_000

POSTAL = re.compile(r"(?<!\d)(\d{2}) ?[-–] ?(\d{3})(?!\d)|(?<![\d/])(\d{5})(?!\d)")
HOUSE = re.compile(r"(?<![\w/])(\d{1,4})(?: ?([a-z])(?![a-z.]))?(?: ?(?:/|lok(?:al)?\.?|m(?:ieszk(?:anie)?)?\.?) ?(\d{1,4})(?!\d))?(?![\w/])")
#: Kinds of street with the usual short forms (folded), and titles that precede a name.
TYPES = {"ul": "ul", "ulica": "ul", "al": "al", "aleja": "al", "aleje": "al", "os": "os", "osiedle": "os", "pl": "pl", "plac": "pl"}
TITLES = set("gen generala prof profesora dr doktora ks ksiedza plk pulkownika mjr majora kpt kapitana sw swietego swietej im inz mgr".split())
COUNTRY = {"polska", "pl", "poland"}
SCHEMA = "street string, postal_code string, city string, raw string, core string, given string, type string, house string, flat string, postal string, town string"


class Towns:
    """The towns of the reference table, to be matched by spelling or by postal code."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.by_code = {c: t for c, t in rows if c and t}
        self.names = {self.fold(t): t for t in self.by_code.values()}
        self.seen: dict[str, str | None] = {}

    @staticmethod
    def fold(text: str) -> str:
        return re.sub("[^a-z]", "", text.lower().translate(FOLD))

    def match(self, text: str) -> str | None:
        key = self.fold(text)
        if len(key) < 4:
            return None
        if key not in self.seen:
            if key in self.names:
                self.seen[key] = self.names[key]
            else:
                best = sorted((d, n) for n in self.names if abs(len(n) - len(key)) <= 2 and (d := distance(n, key)) <= 2)
                clear = best and (len(best) == 1 or best[0][0] < best[1][0])
                self.seen[key] = self.names[best[0][1]] if clear else None
        return self.seen[key]


def _street(words: list[str]) -> tuple[str, str, str]:
    """(core, given, type) of the words of a street name."""
    kind = ""
    while words and words[0] in TYPES:
        kind, words = TYPES[words[0]], words[1:]
    kept = [w for w in words if w not in TITLES]
    if not kept:
        return "", "", kind
    # The last word carries the name; of what stands before it the first letter is kept, as short forms keep it.
    return kept[-1], kept[0][0] if len(kept) > 1 else "", kind


def parse(street: str | None, postal: str | None, city: str | None, raw: str | None, towns: Towns) -> tuple:
    """(core, given, type, house, flat, postal, town); an empty core or house means no place."""
    text = "; ".join(x.strip() for x in (street, raw) if x and x.strip()).lower().translate(FOLD)
    area = "; ".join(x.strip() for x in (postal, city) if x and x.strip()).lower().translate(FOLD)
    code = town = None
    m = POSTAL.search(area) or POSTAL.search(text)
    if m:
        code = f"{m[1]}-{m[2]}" if m[1] else f"{m[3][:2]}-{m[3][2:]}"
    text = POSTAL.sub(" ; ", text)
    area = POSTAL.sub(" ", area)
    area = " ".join(w for w in re.findall(r"[a-z]+", area) if w not in COUNTRY)
    named = area
    text = re.sub(r"\b(ul|al|os|pl)\.", r"\1 ", text)
    m = None
    for m in HOUSE.finditer(text):
        break
    if m is None:
        return "", "", "", "", "", code, towns.match(named) or (towns.by_code.get(code) if code else None) or ""
    house = m[1] + (m[2] or "")
    flat = m[3] or ""
    before, after = text[: m.start()], text[m.end() :]
    parts = [re.findall(r"[a-z]+", p) for p in re.split("[;,]", before)]
    parts = [p for p in ([w for w in p if w not in COUNTRY or w in TYPES and p[-1] != w] for p in parts) if p]
    own = parts[-1] if parts else []
    at = next((i for i, w in enumerate(own) if w in TYPES), None)
    spare = [w for p in parts[:-1] for w in p]
    if at:  # a town stands before the kind of street
        spare += own[:at]
        own = own[at:]
    core, given, kind = _street(own)
    rest = [w for w in re.findall(r"[a-z]+", after) if w not in COUNTRY]
    if not core and spare:  # the number stands before the street
        core, given, kind = _street(rest)
        rest = []
    for option in (named, " ".join(rest), " ".join(spare)):
        town = town or (towns.match(option) if option else None)
    named = named or " ".join(rest) or " ".join(spare)
    if not town and code:
        town = towns.by_code.get(code)
    return core, given, kind, house, flat, code, town or Towns.fold(named)


def parsed(addresses: DataFrame, postal_codes: DataFrame) -> DataFrame:
    """Distinct records with their parts."""
    reference = postal_codes.select("postal_code", "city").distinct()
    rows = [(r[0], r[1]) for r in reference.limit(REFERENCE_ROWS + 1).collect()]
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"the table of postal codes has over {REFERENCE_ROWS} rows")
    keys = ["street", "postal_code", "city", "raw"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        towns = Towns(rows)
        for pdf in batches:
            got = [parse(*r, towns) for r in pdf[keys].astype(object).where(pdf[keys].notna(), None).itertuples(index=False)]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(got, columns=["core", "given", "type", "house", "flat", "postal", "town"])], axis=1)

    return addresses.select(*keys).distinct().mapInPandas(run, SCHEMA)


def street_names(records: DataFrame) -> DataFrame:
    """(core, name): rare street names with the much commoner name that they misspell."""
    counts = cut(records.filter("core <> ''").groupBy("core").agg(F.count(F.lit(1)).alias("n")), "streets")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(c, n, d) for c, n in zip(pdf["core"], pdf["n"], strict=True) for d in deletions(c)], columns=["core", "n", "part"])

    index = cut(counts.mapInPandas(emit, "core string, n bigint, part string"), "street-deletes")
    a, b = index.alias("a"), index.alias("b")
    much = (F.col("b.n") >= 3 * F.col("a.n")) | ((F.col("a.n") == 1) & (F.col("b.n") >= 2))
    met = a.join(b, (F.col("a.part") == F.col("b.part")) & much).filter((F.levenshtein(F.col("a.core"), F.col("b.core"), 4) >= 0)).select("a.core", F.col("b.core").alias("name"), F.col("b.n").alias("m")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            d = [distance(x, y) for x, y in zip(pdf["core"], pdf["name"], strict=True)]
            yield pdf.assign(d=d)[lambda p: (p["d"] <= 2) & ((p["d"] == 1) | (p["core"].str.len() >= 7))]

    near = met.mapInPandas(verify, "core string, name string, m bigint, d int")
    return near.groupBy("core").agg(F.min_by("name", F.struct("d", -F.col("m"), "name")).alias("name"))


#: Share of the weight of a record's elements that a fuller record must have.
CONTAINED = 0.999

#: area is the postal district of a record without town, else empty.
PLACE = ["town", "street_name", "given", "house", "flat", "area"]


def places(addresses: DataFrame, postal_codes: DataFrame) -> DataFrame:
    """(addr_id, place): one row per record that denotes a place."""
    keys = ["street", "postal_code", "city", "raw"]
    rows = addresses.select(F.col("addr_id").cast("bigint").alias("addr_id"), *keys).distinct()
    records = cut(parsed(rows, postal_codes), "addresses")
    better = street_names(records)
    named = records.join(better, "core", "left").withColumn("street_name", F.coalesce("name", "core")).filter("core <> '' AND house <> ''")
    named = named.withColumn("area", F.when(F.col("town") == "", F.coalesce(F.substring("postal", 1, 2), F.lit(""))).otherwise(F.lit("")))
    named = cut(named.select(*keys, *PLACE, "postal"), "named")
    areas = F.array_sort(F.collect_set(F.substring("postal", 1, 2))).alias("areas")  # at most a hundred
    sets = cut(named.groupBy(*PLACE).agg(areas).withColumn("set_id", F.xxhash64(*PLACE)), "sets")
    merged = contained(sets)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    by_row = rows.alias("r").join(named.alias("n"), on).select("r.addr_id", *[f"n.{c}" for c in PLACE])
    return by_row.join(merged, PLACE).select("addr_id", "place").distinct()


def contained(sets: DataFrame) -> DataFrame:
    """The place of each distinct set of parts, by the containment join."""
    have = {"t": F.col("town") != "", "g": F.col("given") != ""}
    base = F.concat_ws("|", "house", "flat")
    # Elements: the parts a record has, each with house and flat, so that none is common.
    elements = F.array_compact(
        F.array(
            F.concat_ws("|", F.lit("s"), "street_name", base),
            F.when(have["t"], F.concat_ws("|", F.lit("t"), "town", "street_name", base)),
            F.when(have["g"], F.concat_ws("|", F.lit("g"), "given", "street_name", base)),
            F.when(have["t"] & have["g"], F.concat_ws("|", F.lit("a"), "town", "given", "street_name", base)),
        )
    )
    full = sets.withColumn("elements", elements)
    exploded = cut(full.select("set_id", F.explode("elements").alias("element")), "elements")
    often = exploded.groupBy("element").agg(F.count(F.lit(1)).alias("df"))
    total = F.lit(float(max(1, sets.count())))
    # The elements of a set (at most four) with their weights, the rarest first.
    item = F.struct("df", (-F.length("element")).alias("long"), "element", F.log(1 + total / F.col("df")).alias("weight"))
    weighed = exploded.join(often, "element").groupBy("set_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    weighed = cut(sets.join(weighed, "set_id"), "weighed")
    lesser = weighed.filter("town = '' OR given = ''")  # sets that another can contain
    index = lesser.select(F.col("items")[0].element.alias("element"), F.col("set_id").alias("small"), F.col("items").alias("s_items"), *[F.col(c).alias(f"s_{c}") for c in [*PLACE, "areas"]])
    probe = weighed.select(F.explode("items.element").alias("element"), F.col("set_id").alias("large"), "items", *PLACE, "areas")
    hits = probe.join(index, "element").filter(F.size("items") > F.size("s_items"))
    weight = lambda items: F.aggregate(items, F.lit(0.0), lambda w, x: w + x.weight)
    there = F.filter("s_items", lambda x: F.array_contains(F.col("items.element"), x.element))
    agrees = weight(there) >= CONTAINED * weight(F.col("s_items"))
    for c in ("street_name", "house", "flat"):
        agrees = agrees & (F.col(f"s_{c}") == F.col(c))
    for c in ("town", "given"):
        agrees = agrees & ((F.col(f"s_{c}") == "") | (F.col(c) == F.col(f"s_{c}")))
    elsewhere = (F.col("s_town") == "") & (F.size("s_areas") > 0) & (F.size("areas") > 0) & ~F.arrays_overlap("s_areas", "areas")
    containing = hits.filter(agrees & ~elsewhere).select("small", "large", "town", "given").distinct()
    # Towns first: among the containers, one town must remain, and inside it one given name or none.
    options = containing.groupBy("small").agg(
        F.collect_set(F.nullif("town", F.lit(""))).alias("towns"), F.collect_set(F.nullif("given", F.lit(""))).alias("givens")
    )
    joined = sets.join(options.withColumnRenamed("small", "set_id"), "set_id", "left")
    only = lambda own, others: F.when(F.col(own) != "", F.col(own)).when(F.size(others) == 1, F.element_at(others, 1)).otherwise(F.col(own))
    town = only("town", F.coalesce("towns", F.array()))
    parts = [town, F.col("street_name"), only("given", F.coalesce("givens", F.array())), F.col("house"), F.col("flat"), F.when(town == "", F.col("area")).otherwise(F.lit(""))]
    return joined.select(*PLACE, F.concat_ws("|", *parts).alias("place"))


def found(addresses: DataFrame, postal_codes: DataFrame) -> DataFrame:
    return pairs(cut(places(addresses, postal_codes), "places"), "addr_id", "place")
