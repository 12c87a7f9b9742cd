"""Column profiles kept as value-count tables.

Every profiled column has a table of (load, value, count). A load adds its counts, a withdrawal
adds them with the sign turned; the profile (null rate, distinct values, range, entropy, broken
values) and the comparison of loads are derived from the maintained counts alone, never from a
second pass over the rows.

Defined cases: null values are counted under a null value; a null struct gives null fields; repeated
rows count as often as they stand there; an empty table gives an empty profile; extra columns of the
input are ignored; a value whose counts sum to zero leaves the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import nip_ok
from ..runtime import cut, shared_folder

#: What a broken-value rule may look at, one slot for each type of context.
JUDGED = "struct<text:string,gross:decimal(20,2),net:decimal(20,2),vat:decimal(20,2),issued:date,due:date>"


@dataclass(frozen=True)
class FieldSpec:
    """One profiled column: its value, what its rule looks at, the rule and its position on a scale."""

    name: str
    value: Column
    judged: Column | None = None
    broken: Column | None = None  # over the column ``judged``
    measure: Column | None = None  # over the column ``judged``; on a coarse scale
    kind: str = "string"  # the column's own type, in whose order its range is taken


def _judged(**parts: Column) -> Column:
    fields = T._parse_datatype_string(JUDGED).fields
    return F.struct(*[(parts[f.name] if f.name in parts else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def invoice_fields() -> list[FieldSpec]:
    """The judged columns of the invoices table with their rules."""
    j = F.col("judged")
    at = F.col
    late = F.datediff(j.due, j.issued)
    nip = lambda c: ~nip_ok(c)
    shape_only = {"broken": nip(j.text)}
    return [
        FieldSpec("issuer.nip", at("issuer.nip"), _judged(text=at("issuer.nip")), **shape_only),
        FieldSpec("receiver.nip", at("receiver.nip"), _judged(text=at("receiver.nip")), **shape_only),
        FieldSpec(
            "summary.total_gross",
            at("summary.total_gross").cast("string"),
            _judged(gross=at("summary.total_gross"), net=at("summary.total_net"), vat=at("summary.total_vat"), text=at("header.invoice_type")),
            broken=((j.gross < 0) & ~F.coalesce(j.text == "correction", F.lit(False)))
            | F.coalesce(F.abs(j.gross - (j.net + j.vat)) > F.lit("0.01").cast("decimal(20,2)"), F.lit(False)),
            measure=F.when(j.gross != 0, F.round(F.log10(F.abs(j.gross).cast("double")), 1)),
            kind="decimal(20,2)",
        ),
        FieldSpec(
            "header.invoice_number",
            at("header.invoice_number"),
            _judged(text=at("header.invoice_number")),
            broken=j.text.rlike(r"[^A-Za-z0-9/_-]") | ~j.text.rlike("[0-9]"),
        ),
        FieldSpec(
            "header.due_date",
            at("header.due_date").cast("string"),
            _judged(issued=at("header.issue_date"), due=at("header.due_date")),
            broken=F.coalesce((j.due < j.issued) | (j.due > F.add_months(j.issued, 120)), F.lit(False)),
            measure=late.cast("double"),
            kind="date",
        ),
    ]


def leaf_fields(schema: T.StructType, skip: tuple[str, ...] = ()) -> list[FieldSpec]:
    """Every leaf of a table's schema as a plain field without rules; arrays and maps count as JSON text."""
    out: list[FieldSpec] = []

    def walk(struct: T.StructType, above: list[str]) -> None:
        for f in struct.fields:
            path = [*above, f.name]
            name = ".".join(path)
            if name in skip:
                continue
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)
                continue
            c = F.col(".".join(f"`{p}`" for p in path))
            nested = isinstance(f.dataType, (T.ArrayType, T.MapType))
            ordered = isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))
            out.append(FieldSpec(name, F.to_json(c) if nested else c.cast("string"), kind=f.dataType.simpleString() if ordered else "string"))

    walk(schema, [])
    return out


def cells(df: DataFrame, fields: list[FieldSpec], load: str = "load_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (row, field): field, load, value, the rule's context and a key of both; one pass over the rows."""
    empty = F.lit(None).cast(JUDGED)
    packed = F.array(
        *[
            F.struct(F.lit(s.name).alias("field"), s.value.cast("string").alias("value"), (empty if s.judged is None else s.judged.cast(JUDGED)).alias("judged"))
            for s in fields
        ]
    )
    out = df.select(*keep, F.col(load).cast("bigint").alias("load"), F.explode(packed).alias("cell")).select(*keep, "load", "cell.*")
    return out.withColumn("key", F.to_json(F.struct(F.col("value").alias("v"), F.col("judged").alias("j"))))


def counts(df: DataFrame, fields: list[FieldSpec], load: str = "load_id") -> DataFrame:
    """The value-count table of a batch of rows: (field, load, key, value, judged, n)."""
    return cells(df, fields, load).groupBy("field", "load", "key").agg(F.first("value").alias("value"), F.first("judged").alias("judged"), F.count(F.lit(1)).alias("n"))


def apply_delta(state: DataFrame, delta: DataFrame, sign: int = 1) -> DataFrame:
    """The state after a signed delta; values whose counts cancel leave it."""
    signed = delta.withColumn("n", F.col("n") * F.lit(sign))
    merged = state.unionByName(signed).groupBy("field", "load", "key").agg(F.first("value").alias("value"), F.first("judged").alias("judged"), F.sum("n").alias("n"))
    return merged.filter(F.col("n") != 0)


class CountStore:
    """A value-count table kept in a folder as signed deltas; survives the session and is opened again by its folder.

    A commit writes its delta (of a load, or of any batch of rows) and then a manifest that names the live
    parts, so a commit that fails half way leaves the version before it. Cost grows with the delta, not with
    the table; only after COMPACT deltas are they folded into one part, whose rows are laid out by load.
    Reading adds the parts up; values whose counts cancel are gone. One writer at a time.
    """

    #: Parts from which a commit folds them into one.
    COMPACT = 16

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        """The complete versions in the folder, in order."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The parts of a version (the last one unless named)."""
        at = self.version if version is None else version
        if not at:
            return []
        return sorted(r["value"] for r in self.spark.read.text(f"{self.folder}/manifest/v{at}").collect())  # at most COMPACT lines

    def _added(self, parts: list[str]) -> DataFrame:
        deltas = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in parts])
        if len(parts) == 1:
            return deltas.filter(F.col("n") != 0)
        merged = deltas.groupBy("field", "load", "key").agg(F.first("value").alias("value"), F.first("judged").alias("judged"), F.sum("n").alias("n"))
        return merged.filter(F.col("n") != 0)

    def read(self, version: int | None = None) -> DataFrame:
        parts = self.parts(version)
        if not parts:
            raise ValueError(f"no version in {self.folder}")
        return self._added(parts)

    def commit(self, delta: DataFrame, sign: int = 1) -> DataFrame:
        """Adds a batch's counts (or takes them away, with sign -1) and gives the new state."""
        parts, at = self.parts(), self.version + 1
        name = f"delta-{at}-{uuid.uuid4().hex}"
        delta.withColumn("n", F.col("n") * F.lit(sign)).write.parquet(f"{self.folder}/{name}")
        parts = [*parts, name]
        if len(parts) >= self.COMPACT:
            whole = f"whole-{at}-{uuid.uuid4().hex}"
            self._added(parts).sortWithinPartitions("load", "field").write.parquet(f"{self.folder}/{whole}")
            parts = [whole]
        self.spark.createDataFrame([(p,) for p in parts], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v{at}")
        return self._added(parts)


def _broken_column(fields: list[FieldSpec]) -> Column:
    out = F.lit(False)
    for s in fields:
        if s.broken is not None:
            out = F.when(F.col("field") == s.name, F.col("value").isNotNull() & F.coalesce(s.broken, F.lit(False))).otherwise(out)
    return out


def _measure_column(fields: list[FieldSpec]) -> Column:
    out = F.lit(None).cast("double")
    for s in fields:
        if s.measure is not None:
            out = F.when(F.col("field") == s.name, s.measure).otherwise(out)
    return out


#: Stands for all rare notations; no notation holds it, since digits become 9.
RARE = "0"


def notation(value: Column) -> Column:
    """The shape of a value: runs of digits, capitals and small letters each become one sign; a long shape ends in its hash."""
    v = F.regexp_replace(value, "[0-9]+", "9")
    v = F.regexp_replace(v, r"\p{Lu}+", "A")
    v = F.regexp_replace(v, r"\p{Ll}+", "a")
    return F.when(F.length(v) <= 40, v).otherwise(F.concat(F.substring(v, 1, 40), F.sha2(v, 256)))


def _typed_ranges(fields: list[FieldSpec]) -> tuple[list[Column], Column, Column]:
    """Aggregates of the least and largest value in each type of the fields, and both ends as text."""
    slots, low, high = [], F.col("min_text"), F.col("max_text")
    for k, kind in enumerate(sorted({s.kind for s in fields} - {"string"})):
        own = F.col("field").isin(*[s.name for s in fields if s.kind == kind])
        typed = F.when(own, F.col("value").cast(kind))
        slots += [F.min(typed).alias(f"_low{k}"), F.max(typed).alias(f"_high{k}")]
        low = F.when(own, F.col(f"_low{k}").cast("string")).otherwise(low)
        high = F.when(own, F.col(f"_high{k}").cast("string")).otherwise(high)
    return slots, low, high


def profile(state: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """The whole-table profile of every field, from the maintained counts.

    The range (min_value, max_value) is in the order of the column's own type and written as text;
    min_text and max_text are the ends in text order.
    """
    slots, low, high = _typed_ranges(fields)
    values = state.groupBy("field", "value").agg(F.sum("n").alias("n"), F.sum(F.when(_broken_column(fields), F.col("n")).otherwise(0)).alias("bad"))
    there = F.col("value").isNotNull()
    n = F.col("n").cast("double")
    return (
        values.groupBy("field")
        .agg(
            F.sum("n").alias("rows"),
            F.sum(F.when(~there, F.col("n")).otherwise(0)).alias("nulls"),
            F.count("value").alias("distinct_values"),
            F.min("value").alias("min_text"),
            F.max("value").alias("max_text"),
            *slots,
            F.min(F.length("value")).alias("min_length"),
            F.max(F.length("value")).alias("max_length"),
            F.sum("bad").alias("broken"),
            F.sum(F.when(there, n)).alias("_n"),
            F.sum(F.when(there, n * F.log2(n))).alias("_nlogn"),
        )
        .select(
            "field",
            "rows",
            "nulls",
            F.round(F.col("nulls") / F.col("rows"), 6).alias("null_rate"),
            "distinct_values",
            low.alias("min_value"),
            high.alias("max_value"),
            "min_text",
            "max_text",
            "min_length",
            "max_length",
            F.when(F.col("field").isin(*[s.name for s in fields if s.broken is not None]), F.col("broken")).alias("broken"),
            F.abs(F.round(F.log2(F.col("_n")) - F.col("_nlogn") / F.col("_n"), 4)).alias("entropy"),
        )
    )


def load_metrics(state: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """Per (field, load): rows, null share, share of the commonest value, median on the field's scale."""
    at = state.withColumn("m", _measure_column(fields))
    values = at.groupBy("field", "load", "value").agg(F.sum("n").alias("n"))
    share = values.groupBy("field", "load").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"),
    )
    scale = (
        at.filter(F.col("m").isNotNull())
        .groupBy("field", "load", "m")
        .agg(F.sum("n").alias("n"))
        .groupBy("field", "load")
        .agg(F.expr("percentile(m, 0.5, n)").alias("middle"))
    )
    known = F.col("rows") - F.col("nulls")
    return share.join(scale, ["field", "load"], "left").select(
        "field", "load", "rows", (F.col("nulls") / F.col("rows")).alias("null_share"), F.when(known > 0, F.col("top") / known).alias("top_share"), "middle"
    )


def notation_distance(state: DataFrame) -> DataFrame:
    """Per (field, load): half the summed difference between the load's notation shares and the median shares.

    Notations that stay under 2 % in every load are pooled as one, so the table is bounded by loads times a
    few notations; a share that a load lacks counts as zero. What is used several times is cut, else the
    driver plans the counts' whole lineage once for every use.
    """
    shapes = cut(state.filter(F.col("value").isNotNull()).withColumn("shape", notation(F.col("value"))).groupBy("field", "load", "shape").agg(F.sum("n").alias("n")), "shapes")
    totals = shapes.groupBy("field", "load").agg(F.sum("n").alias("known"))
    shares = shapes.join(totals, ["field", "load"]).withColumn("share", F.col("n") / F.col("known"))
    usual = shares.filter(F.col("share") >= 0.02).select("field", "shape").distinct().withColumn("kept", F.col("shape"))
    pooled = shares.join(usual, ["field", "shape"], "left").withColumn("shape", F.coalesce("kept", F.lit(RARE)))
    shares = cut(pooled.groupBy("field", "load", "shape").agg(F.sum("share").alias("share")), "shares")
    common = shares.select("field", "shape").distinct()
    grid = totals.join(common, "field").join(shares, ["field", "load", "shape"], "left")
    grid = grid.withColumn("share", F.coalesce(F.col("share"), F.lit(0.0)))
    grid = grid.withColumn("usual", F.expr("percentile(share, 0.5)").over(Window.partitionBy("field", "shape")))
    return grid.groupBy("field", "load").agg((F.sum(F.abs(F.col("share") - F.col("usual"))) / 2).alias("apart"))


def load_departures(state: DataFrame, fields: list[FieldSpec], skip: tuple[str, ...] = ()) -> DataFrame:
    """Loads in which a field departs plainly from the bulk of the loads, with the measures that depart.

    A share departs when it is off the median of the loads by more than a tenth (by more than 0.1 of the
    whole), by more than six robust deviations and by more than five sampling deviations; a notation mix
    when it is apart by 0.25; a range when its middle moves by more than eight robust deviations and by
    a whole unit of the scale (a power of ten of an amount, or half of it, or 21 days).
    """
    off = cut(load_metrics(state, fields).join(notation_distance(state), ["field", "load"], "left"), "loads")
    measures, of_field = ["null_share", "top_share", "middle"], Window.partitionBy("field")
    off = off.withColumns({f"usual_{c}": F.expr(f"percentile({c}, 0.5)").over(of_field) for c in measures})
    off = off.withColumns({f"spread_{c}": F.expr(f"percentile(abs({c} - usual_{c}), 0.5)").over(of_field) * 1.4826 for c in measures})

    def share(c: str) -> Column:
        gap, p = F.abs(F.col(c) - F.col(f"usual_{c}")), F.col(f"usual_{c}")
        noise = F.sqrt(F.greatest(p * (1 - p), F.lit(0.01)) / F.col("rows"))
        return (gap > 0.1) & (gap > 6 * F.col(f"spread_{c}")) & (gap > 5 * noise)

    gap = F.abs(F.col("middle") - F.col("usual_middle"))
    unit = F.when(F.col("field").endswith("_date"), 21.0).otherwise(0.7)
    flags = F.array_compact(
        F.array(
            F.when(share("null_share"), F.lit("nulls")),
            F.when(share("top_share"), F.lit("repetition")),
            F.when(F.col("apart") > 0.25, F.lit("notation")),
            F.when((gap >= unit) & (gap > 8 * F.col("spread_middle")), F.lit("range")),
        )
    )
    out = off.withColumn("departs", flags).filter(F.size("departs") > 0)
    return out.filter(~F.col("field").isin(*skip)) if skip else out


def broken_rows(df: DataFrame, state: DataFrame, fields: list[FieldSpec], row_id: str = "row_id", load: str = "load_id") -> DataFrame:
    """(field, row id) of every row that holds a value which the counts table knows as broken."""
    bad = state.filter(_broken_column(fields)).select("field", "key").distinct()
    return cells(df, fields, load, keep=(row_id,)).filter(F.col("value").isNotNull()).join(bad, ["field", "key"], "left_semi").select("field", F.col(row_id).cast("bigint").alias("ref_id"))


def quality_cases(invoices: DataFrame) -> DataFrame:
    """Broken values and departing loads of the judged invoice columns: (field, kind, ref_id)."""
    fields = invoice_fields()
    store = CountStore(invoices.sparkSession)
    state = store.commit(counts(invoices, fields))
    values = broken_rows(invoices, state, fields).withColumn("kind", F.lit("value"))
    loads = load_departures(state, fields, skip=("receiver.nip",)).select("field", F.lit("load").alias("kind"), F.col("load").alias("ref_id"))
    return values.select("field", "kind", "ref_id").unionByName(loads).distinct()
