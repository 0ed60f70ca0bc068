"""A section classifier on Spark: hashed words of title and text, class-weighted multinomial regression, softmax."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.imrad import heuristic_label
from tessera.functions.text import all_tokens, title_norm
from tessera.operators.evaluation import averaged, class_report, class_weights

#: Features, and labelled sections that a fit takes, about.
FEATURES, SAMPLE = 1 << 14, 200_000


def words(title: Column, text: Column) -> Column:
    """The title's words, marked as such, and the text's; a null counts as empty."""
    marked = F.transform(all_tokens(title_norm(title)), lambda w: F.concat(F.lit("title:"), w))
    return F.concat(marked, all_tokens(F.coalesce(text, F.lit(""))))


def features(sections: DataFrame) -> DataFrame:
    """``sections`` (title, text, ...) with a column of hashed counts."""
    own = sections.withColumn("_words", words(F.col("title"), F.col("text")))
    return HashingTF(numFeatures=FEATURES, inputCol="_words", outputCol="_features").transform(own).drop("_words")


@dataclass(frozen=True)
class Classifier:
    """A fitted model and its classes in order."""

    model: LogisticRegressionModel
    classes: list[str]

    def over(self, sections: DataFrame) -> DataFrame:
        """``sections`` with class, class_confidence and probs (in order of the classes); of equal ones the first."""
        scored = self.model.transform(features(sections))
        p = vector_to_array("_p")
        best = F.array_position(p, F.array_max(p)).cast("int")
        named = F.element_at(F.array(*map(F.lit, self.classes)), best)
        return scored.select(*sections.columns, named.alias("class"), F.array_max(p).alias("class_confidence"), p.alias("probs"))

    def classified(self, folded: DataFrame) -> DataFrame:
        """What ``sections.label`` takes, of the sections whose title the heuristic does not know: (paper_id, title_norm, class, class_confidence, probs).

        The others keep the label of their title whatever a classifier says, so their texts are not read.
        """
        return self.over(folded.where(heuristic_label(F.col("title_norm")).isNull())).select("paper_id", "title_norm", "class", "class_confidence", "probs")

    def report(self, held_out: DataFrame) -> DataFrame:
        """Macro, weighted and micro F1 on sections with their ``label``."""
        said = self.over(held_out.where(F.col("label").isin(*self.classes)))
        return averaged(class_report(said, "label", "class"))


def fit(labelled: DataFrame, classes: list[str], sample: int = SAMPLE, regularise: float = 0.01, rounds: int = 60, seed: int = 17) -> Classifier:
    """Fit on (title, text, label) of the given classes.

    About ``sample`` rows are taken, those of least hash of their own values: a stated bound on the fit alone, the same
    rows on every run. Each class weighs the same in all. Rows of other labels take no part.
    """
    known = labelled.where(F.col("label").isin(*classes)).select("title", "text", "label")
    share = min(1.0, sample / max(1, known.count()))
    h = F.pmod(F.xxhash64(F.lit(seed), "title", "text", "label"), F.lit(1 << 31))
    drawn = known.where(h < int(share * (1 << 31))) if share < 1 else known
    there = {r["label"]: r["weight"] for r in class_weights(drawn, "label").collect()}
    if len(there) < 2:
        raise ValueError(f"two classes are needed, and {sorted(there)} are there")
    own = [c for c in classes if c in there]
    number = F.create_map(*[F.lit(x) for i, c in enumerate(own) for x in (c, float(i))])
    weight = F.create_map(*[F.lit(x) for c in own for x in (c, there[c])])
    # In a fixed order and number of parts, so that sums come out alike.
    rows = features(drawn).select(number[F.col("label")].alias("_y"), weight[F.col("label")].alias("_w"), "_features", h.alias("_h")).repartitionByRange(32, "_h").sortWithinPartitions("_h").drop("_h")
    model = LogisticRegression(featuresCol="_features", labelCol="_y", weightCol="_w", probabilityCol="_p", family="multinomial", regParam=regularise, maxIter=rounds).fit(rows)
    return Classifier(model, own)
