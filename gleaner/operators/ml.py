"""Features and classifiers for short texts, on Spark ML."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.corpus import kfold
from gleaner.operators.numbering import discard, materialize

VOCABULARY, SEQUENCE = 2000, 1500
TOKEN = r"[^a-z0-9']+"
#: Bytes that ``words_in`` leaves; any other is a blank.
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789'" else 32 for c in range(256))
#: Different words that a task counts before it passes their counts on.
COUNTED = 200_000


def tokens(text: Column) -> Column:
    """Lower-case words of a-z, 0-9 and apostrophes."""
    return F.filter(F.split(F.lower(text), TOKEN), lambda w: w != "")


def words_in(text: bytes | None) -> list[bytes]:
    """The words of ``tokens`` in a task; ten times as fast as the expression, which splits by a regular one."""
    if text is None:
        return []
    lowered = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lowered.translate(_KEPT).split()


def vocabulary(rows: DataFrame, text: str, size: int = VOCABULARY) -> DataFrame:
    """(word, n): the most frequent words; of equal counts the first in order."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                counts.update(words_in(t.as_py()))
                if len(counts) > COUNTED:
                    yield told()
                    counts.clear()
        yield told()

    words = rows.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long")  # partial counts meet, not words
    return words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def sequences(rows: DataFrame, text: str, words: list[str], length: int = SEQUENCE) -> DataFrame:
    """Word numbers from 2 on (1 for unknown words) of the last ``length`` words, zeros at the end.

    Arrow batches, as no built-in looks words up in a table without a scan of it; ``words`` is
    the vocabulary, of VOCABULARY words or so.
    """
    shared = rows.sparkSession.sparkContext.broadcast({w.encode(): i + 2 for i, w in enumerate(words)})

    @F.arrow_udf("array<int>")
    def numbers(texts: pa.Array) -> pa.Array:
        of, out = shared.value, np.zeros((len(texts), length), np.int32)
        for i, t in enumerate(texts.cast(pa.binary())):
            last = words_in(t.as_py())[-length:] if length else []
            out[i, : len(last)] = [of.get(w, 1) for w in last]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * length, pa.int32()), pa.array(out.ravel()))

    return rows.withColumn("sequence", numbers(F.col(text).cast("string")))


def tfidf(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, weight): L2-normed term counts times ln((1+n)/(1+df))+1, as relations.

    A text's words are counted in its row; terms meet by key and word only where a key has several
    rows. The words' document counts are written, so that the join knows their size and spares the
    terms a shuffle by word, in which words of all texts would be hot, where it is small.
    """
    rows = rows.select(key, F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            ends, words, times = [0], [], []
            for t in batch.column(1).cast(pa.binary()):
                counts = Counter(words_in(t.as_py()))
                words.extend(counts)
                times.extend(counts.values())
                ends.append(len(words))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            found = [batch.column(0).take(pa.array(of)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())]
            yield from pa.Table.from_arrays(found, [key, "word", "tf"]).to_batches(max_chunksize=1 << 16)

    n, kind = rows.select(key).distinct().count(), rows.schema[key].dataType.simpleString()
    terms = rows.mapInArrow(run, f"`{key}` {kind}, word string, tf long")
    if rows.select(key).count() > n:
        terms = terms.groupBy(key, "word").agg(F.sum("tf").alias("tf"))
    terms = materialize(terms, "terms")
    df = materialize(terms.groupBy("word").agg(F.count("*").alias("df")), "term-counts")
    raw = terms.join(df, "word").select(key, "word", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # the words of a text
    return raw.select(key, "word", (F.col("w") / norm).alias("weight"))


class WordCounts(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """How often a text has each word of a vocabulary, as a sparse vector; null has none."""

    vocabulary = Param(Params._dummy(), "vocabulary", "the words that count", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, vocabulary: list[str] | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = self.getOrDefault(self.vocabulary)
        shared, size = dataset.sparkSession.sparkContext.broadcast({w.encode(): i for i, w in enumerate(words)}), len(words)

        @F.arrow_udf(VectorUDT())
        def counted(texts: pa.Array) -> pa.Array:
            of, ends, places, times = shared.value, [0], [], []
            for t in texts.cast(pa.binary()):
                found = sorted(Counter(of[w] for w in words_in(t.as_py()) if w in of).items())
                places.extend(i for i, _ in found)
                times.extend(n for _, n in found)
                ends.append(len(places))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, k)) for v, k in ((places, pa.int32()), (times, pa.float64()))]
            n = len(texts)
            return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), *lists], ["type", "size", "indices", "values"])

        return dataset.withColumn(self.getOutputCol(), counted(F.col(self.getInputCol()).cast("string")))


def train_classifier(rows: DataFrame, text: str = "description", label: str = "label", size: int = VOCABULARY, kind: str = "logistic", seed: int = 42) -> PipelineModel:
    """Label index, TF-IDF and a classifier: "logistic", "ovr" (one against the rest) or "perceptron".

    Texts are read twice, for the vocabulary and for their counts of it, which are written; what
    is fitted after that reads the counts.
    """
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    words = [r["word"] for r in vocabulary(rows, text, size).collect()]  # ``size`` words
    counter = WordCounts(inputCol=text, outputCol="_counts", vocabulary=words)
    counted = materialize(indexer.transform(counter.transform(rows)).select("_label", "_counts"), "word-counts")
    idf, normal = IDF(inputCol="_counts", outputCol="_idf").fit(counted), Normalizer(inputCol="_idf", outputCol="features")
    if kind == "perceptron":
        base = MultilayerPerceptronClassifier(layers=[len(words), 64, len(indexer.labels) + 1], labelCol="_label", seed=seed, blockSize=32)
    else:
        base = LogisticRegression(labelCol="_label", regParam=0.01, maxIter=50)
        base = OneVsRest(classifier=base, labelCol="_label") if kind == "ovr" else base
    model = base.fit(normal.transform(idf.transform(counted)).select("_label", "features"))
    discard(counted)
    return PipelineModel(stages=[indexer, counter, idf, normal, model])


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with ``predicted`` and, if the model has them, ``scores`` by class."""
    out = model.transform(rows)
    labels = [*model.stages[0].labels, "__unknown"]
    out = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels).transform(out)
    if "probability" in out.columns:
        out = out.withColumn("scores", vector_to_array("probability"))
    return out.select(*rows.columns, "predicted", *(["scores"] if "probability" in model_columns(model) else []))


def model_columns(model: PipelineModel) -> list[str]:
    last = model.stages[-1]
    return ["probability"] if last.hasParam("probabilityCol") else []


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def cross_accuracy(rows: DataFrame, text: str, label: str, k: int = 5, order: str = "seq") -> float:
    """Mean accuracy over stratified folds; 0 where a class has fewer than two rows."""
    folded = materialize(kfold(rows.select(order, text, label), label, k, F.col(order)), "folds")
    folds = sorted(r["fold"] for r in folded.select("fold").distinct().collect())  # at most k
    scores = []
    for fold in folds:
        model = train_classifier(folded.where(F.col("fold") != fold), text, label)
        got = predict(model, folded.where(F.col("fold") == fold))
        scores.append(got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("a")).first()["a"] or 0.0)
    discard(folded)
    return sum(scores) / len(scores) if scores else 0.0
