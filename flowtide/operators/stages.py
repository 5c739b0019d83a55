"""Pipeline stages of the cascade that can be saved and loaded with the models around them.

Every stage keeps all columns of a row and adds one more. They are row-local, so a pipeline of them works on tables
and on streams alike, without joins, shuffles or written tables; only a neighbour stage with more references than
a task should hold compares by an exact join, and scores a stream batch by batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Model, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide.operators.encoding import FlowEncoder
from flowtide.operators.neighbors import first_of, nearest_places, stored_references
from flowtide.session import materialize

#: References that every task may hold; more of them stay in a written table, none is left out.
MAX_REFERENCES = 100_000


class EncoderStage(Transformer, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``FlowEncoder`` as a stage: its features as one vector beside the columns of the row."""

    document = Param(Params._dummy(), "document", "the fitted encoder", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, document: str = "{}", outputCol: str = "features"):
        super().__init__()
        self._setDefault(document="{}", outputCol="features")
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, encoder: FlowEncoder, out: str) -> EncoderStage:
        return cls(document=json.dumps(asdict(encoder)), outputCol=out)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = json.loads(self.getOrDefault(self.document))
        ones = [F.coalesce((F.col(c) == value).cast("double"), F.lit(0.0)) for c, values in fitted["categories"].items() for value in values]
        scaled = [
            F.coalesce((F.col(c).cast("double") - mean) / std, F.lit(float("nan"))) for c, (mean, std) in fitted["numeric"].items()]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*ones, *scaled)))


class HighestStage(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The place of the class whose own model scores it highest; ties go to the first. One-vs-rest models of Spark
    write their rows aside to do this, which a stream cannot."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, outputCol: str = "prediction"):
        super().__init__()
        self._setDefault(inputCols=[], outputCol="prediction")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        scores = F.array(*[F.get(vector_to_array(c), F.lit(1)) for c in self.getInputCols()])
        return df.withColumn(self.getOutputCol(), (F.array_position(scores, F.array_max(scores)) - 1).cast("double"))


class _NeighbourWriter(MLWriter):
    def __init__(self, stage: NeighbourStage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        if self.stage.table is not None:
            self.stage.table.write.mode("overwrite").parquet(f"{path}/references")
            return
        rows = [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(zip(self.stage.vectors, self.stage.labels))]
        table = self.sparkSession.createDataFrame(rows, "place long, vector array<double>, label int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/references")


class _NeighbourReader(MLReader):
    def load(self, path: str) -> NeighbourStage:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.parquet(f"{path}/references")
        stage = NeighbourStage()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        return stage.of_table(table)


def _ranked_places(some: np.ndarray, references: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The places of the first ``k`` references of every row. Those without a finite distance come last, in their order."""
    wide = min(k, len(references))
    finite = np.isfinite(references).all(axis=1)
    rest = np.concatenate((np.flatnonzero(finite), np.flatnonzero(~finite)))
    q, r, _ = nearest_places(some, references, k, metric)
    near = np.tile(np.arange(wide), (len(some), 1))
    near[q, np.arange(len(q)) - np.searchsorted(q, q)] = r
    found = np.bincount(q, minlength=len(some))
    for i in np.flatnonzero((found < wide) & ~np.isnan(some).any(axis=1)):
        own = near[i, : found[i]]
        near[i, found[i] :] = rest[~np.isin(rest, own)][: wide - found[i]]
    return near


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _voted(some: np.ndarray, references: np.ndarray, labels: np.ndarray, k: int, metric: str) -> np.ndarray:
    """The label that most of the ``k`` nearest references of each row have."""
    classes = np.unique(labels)
    of = np.searchsorted(classes, labels)
    votes = (of[_ranked_places(some, references, k, metric)][:, :, None] == np.arange(len(classes))).sum(axis=1)
    return classes[votes.argmax(axis=1)]


def _shaped(df: DataFrame, column: str, metric: str) -> DataFrame:
    """The vectors of ``column`` as they are compared, by the same arithmetic as in ``_transform``."""
    if metric != "cosine":
        return df

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                yield rows.assign(**{column: list(_unit(np.stack(rows[column].to_numpy()).astype(np.float64, copy=False)))})

    return df.mapInPandas(shape, df.schema)


def _finite(vector: str) -> Column:
    return F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


class NeighbourStage(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """The label that most of a row's ``k`` nearest references have; ties go to the smallest. All references are
    compared. With few of them every task holds them, and a row is compared where it is; more are a written table
    (``table``), and rows meet them in the exact neighbour join. With ``whenCol`` only rows where that is true are
    compared; the others get null."""

    k = Param(Params._dummy(), "k", "neighbours that vote", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "distance", TypeConverters.toString)
    whenCol = Param(Params._dummy(), "whenCol", "rows to compare", TypeConverters.toString)

    def __init__(self, k: int = 3, metric: str = "euclidean", inputCol: str = "features", outputCol: str = "knn", whenCol: str = ""):
        super().__init__()
        self._set(k=k, metric=metric, inputCol=inputCol, outputCol=outputCol, whenCol=whenCol)
        self.holding([], [])

    def holding(self, vectors: list, labels: list) -> NeighbourStage:
        self.vectors, self.labels = np.asarray(vectors, dtype=np.float64), np.asarray(labels, dtype=np.int64)
        self.table, self.index = None, None
        return self

    def remember(self, rows: DataFrame, row_id: str, vector: str = "features", label: str = "target") -> NeighbourStage:
        """Compare with all rows; of those equally near the ones with the smallest ids come first."""
        known = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(
            F.col(row_id).alias("id"), vector_to_array(vector).alias("vector"), F.col(label).cast("int").alias("label"))
        if known.limit(MAX_REFERENCES + 1).count() <= MAX_REFERENCES:
            found = sorted(known.collect(), key=lambda r: (r["id"] is None, r["id"], r["label"]))
            return self.holding([r["vector"] for r in found], [r["label"] for r in found])
        # places that follow the order of the ids: parts are ranges of them, and a part is numbered on its own
        order = [F.col("id").asc_nulls_last(), F.col("label"), F.xxhash64("vector")]
        parts = max(2, 4 * rows.sparkSession.sparkContext.defaultParallelism)
        dealt = known.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        return self.of_table(materialize(dealt.select(F.monotonically_increasing_id().alias("place"), "vector", "label"), "references"))

    def of_table(self, table: DataFrame) -> NeighbourStage:
        """Compare with the rows of a table of ``place``, ``vector`` and ``label``; it is held if it is small."""
        k, metric = self.getOrDefault(self.k), self.getOrDefault(self.metric)
        if table.limit(MAX_REFERENCES + 1).count() <= MAX_REFERENCES:
            return self._holding_rows(table)
        shaped = _shaped(table, "vector", metric)
        known = _finite("vector")
        # what a row without a distance to anything falls back on: the first of all, of the finite and of the others
        first = {r["place"] for some in (F.lit(True), known, ~known) for r in shaped.where(some).orderBy("place").limit(k).collect()}
        self._holding_rows(table.where(F.col("place").isin(sorted(first))))
        if shaped.where(known).limit(k).count() < k:  # these are all that can be near
            return self
        self.classes = sorted(r["label"] for r in table.select("label").distinct().collect())
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("label")) - 1
        # the label travels in the number of the reference, below its place
        references = shaped.where(known).select((F.col("place") * len(self.classes) + code).alias("__r"), F.col("vector").alias("__v"))
        self.table, self.index = table, stored_references(references, k, self._distance())
        return self

    def sharing(self, other: NeighbourStage) -> NeighbourStage:
        """Compare with the references of another stage."""
        return self.holding(other.vectors, other.labels) if other.table is None else self.of_table(other.table)

    def _holding_rows(self, rows: DataFrame) -> NeighbourStage:
        found = rows.orderBy("place").collect()
        return self.holding([r["vector"] for r in found], [r["label"] for r in found])

    def _distance(self) -> str:
        """Metric of vectors that are at unit length where that matters."""
        metric = self.getOrDefault(self.metric)
        return "euclidean" if metric == "cosine" else metric

    def write(self) -> _NeighbourWriter:
        return _NeighbourWriter(self)

    @classmethod
    def read(cls) -> _NeighbourReader:
        return _NeighbourReader()

    def _transform(self, df: DataFrame) -> DataFrame:
        if not len(self.labels):
            return df.withColumn(self.getOutputCol(), F.lit(None).cast("int"))
        wanted = self.getOrDefault(self.whenCol)
        vector = vector_to_array(self.getInputCol())
        asked = F.when(F.col(wanted), vector) if wanted else vector
        if self.table is None:
            return df.withColumn(self.getOutputCol(), self._vote(df, asked))
        if df.isStreaming:
            raise ValueError("these references are a table, which a stream meets batch by batch: streams.score_batches")
        return self._by_join(df, asked)

    def _vote(self, df: DataFrame, asked: Column) -> Column:
        """Votes of the held references."""
        k, metric = self.getOrDefault(self.k), self.getOrDefault(self.metric)
        vectors = _unit(self.vectors) if metric == "cosine" else self.vectors
        shared = df.sparkSession.sparkContext.broadcast((vectors, self.labels))

        @F.pandas_udf("int")
        def vote(rows: pd.Series) -> pd.Series:
            references, labels = shared.value
            known = np.flatnonzero(rows.notna().to_numpy())
            out = np.full(len(rows), np.nan)
            if len(known):
                some = np.asarray([rows.iloc[i] for i in known], dtype=np.float64)
                out[known] = _voted(_unit(some) if metric == "cosine" else some, references, labels, k, metric)
            return pd.Series(out).astype("Int32")

        # so that the vote stays a column of its own, and is not put into the functions over arrays of votes
        return vote.asNondeterministic()(asked)

    def _by_join(self, df: DataFrame, asked: Column) -> DataFrame:
        """Votes of the table: each distinct vector is compared once, and its rows meet its vote in an equi-join."""
        k, out = self.getOrDefault(self.k), self.getOutputCol()
        rows = df.withColumn("__asked", asked)
        distinct = rows.select("__asked").where(F.col("__asked").isNotNull()).distinct()
        numbered = materialize(distinct.select(F.monotonically_increasing_id().alias("__q"), F.col("__asked").alias("__v")), "asked")
        near = _shaped(numbered, "__v", self.getOrDefault(self.metric)).where(_finite("__v"))
        found = first_of(near, self.index, k)
        votes = found.groupBy("__q", F.pmod("__r", F.lit(len(self.classes))).alias("__code")).agg(F.count(F.lit(1)).alias("__n"))
        code = votes.groupBy("__q").agg(F.min_by("__code", F.struct(-F.col("__n"), F.col("__code"))).alias("__code"))
        label = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("__code").cast("int"))
        known = materialize(numbered.join(code, "__q").select(F.col("__v").alias("__key"), label.alias("__near")), "votes")
        # rows that are not asked have no key in common and are dealt by their number
        salt = F.when(F.col("__asked").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(-1).cast("long"))
        salted = rows.withColumn("__salt", salt)
        met = (F.col("__salt") == F.col("__whole")) & (F.col("__asked") == F.col("__key"))
        joined = salted.join(known.withColumn("__whole", F.lit(-1).cast("long")), met, "left")
        # rows without a distance vote by the order of the references, as those that are held do
        rest = self._vote(df, F.when(F.col("__near").isNull(), F.col("__asked")))
        voted = joined.withColumn("__rest", rest).withColumn(out, F.coalesce("__near", "__rest"))
        return voted.select(*[F.col(f"`{c}`") for c in df.columns if c != out], out)
