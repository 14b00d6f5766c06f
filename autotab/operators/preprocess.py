"""Preprocessor assembly (ordinal map → frequency encode → numeric / binary /
categorical / hash branches → optional MI selection → vector), fitted as one
Spark ML Estimator. Each stage fits on the output of the previous ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import named, quoted
from . import features as FT
from .profile import at_least_distinct, correlation_filter, numeric_columns, skewness


@dataclass(frozen=True)
class PreprocessOptions:
    power_transform: bool | str = "auto"     # "auto": the skewed continuous columns
    scale_for: tuple[str, ...] = ("linear", "logistic", "mlp")
    one_hot_for: tuple[str, ...] | None = ("linear", "logistic", "mlp")
    one_hot_columns: int = 256               # a column with more categories becomes one sparse vector
    freq_encode_high_card: bool = True
    high_card_threshold: int = 50
    numeric_imputer: str = "median"
    categorical_imputer: str = "most_frequent"
    drop_low_variance: bool = False
    low_variance_threshold: float = 0.0
    select_k_best: int | str | None = None
    select_k_bounds: tuple[int, int] = (10, 80)
    select_k_by: str = "knn"                 # estimator of the mutual information: "knn" or "binned"
    correlation_filter: bool = False
    correlation_threshold: float = 0.98
    ordinal_mappings: dict[str, dict[str, int]] | None = None
    rare_min_freq: float | None = None
    hash_text: bool = False
    hash_n_features: int = 512
    svd_components: int | None = None
    keyed: tuple[str, ...] = ()              # columns that hold the value keys of texts, for their frequencies


#: The assembled vector before a projection.
WIDE = "__wide"


class PreprocessorModel(FT._Fitted):
    def __init__(self, stages, names, output, hash_stage=None, svd=None, sparse=None):
        super().__init__({"names": names, "output": output})
        self.stages, self.hash_stage, self.svd, self.sparse = stages, hash_stage, svd, sparse

    @property
    def feature_names(self) -> list[str]:
        names = list(self.state["names"])
        if self.sparse is not None:
            names += self.sparse.feature_names()
        if self.hash_stage is not None:
            names += [f"hash_{i}" for i in range(self.hash_stage.state["n_features"])]
        if self.svd is not None:
            names = [f"svd_{i}" for i in range(self.svd.k)]
        return names

    def transform_columns(self, df: DataFrame) -> DataFrame:
        """Apply the column stages only (named numeric feature columns, no vector)."""
        d = df
        for st in self.stages:
            d = st.transform(d)
        return d

    def _transform(self, df):
        d = self.transform_columns(df)
        # the assembler reads columns of its own, so display names may hold anything
        parts = [f"__f{i}" for i in range(len(self.state["names"]))]
        d = d.selectExpr("*", *[f"{quoted(n)} AS {p}" for p, n in zip(parts, self.state["names"], strict=True)]) if parts else d
        extra = []
        if self.sparse is not None:
            d = self.sparse.transform(d)
            extra += self.sparse.output_columns()
        if self.hash_stage is not None:
            d = self.hash_stage.transform(d)
            extra += [self.hash_stage.state["output"]]
        out = self.state["output"]
        d = VectorAssembler(inputCols=parts + extra, outputCol=out if self.svd is None else WIDE, handleInvalid="keep").transform(d).drop(*parts, *(self.sparse.output_columns() if self.sparse is not None else []))
        return d if self.svd is None else self.svd.transform(d).drop(WIDE)


class Preprocessor(Estimator):
    """Builds and fits the feature pipeline for one model family.

    family decides scaling (``scale_for``) and one-hot vs ordinal codes
    (``one_hot_for``); ``select_k`` keeps the top-k features by binned mutual
    information with ``target``."""

    def __init__(self, features: list[str], family: str = "logistic", task: str = "classification",
                 cfg: PreprocessOptions | None = None, target: str | None = None, select_k: int | None = None,
                 output: str = "features"):
        super().__init__()
        self.features, self.family, self.task = list(features), family, task
        self.cfg = cfg or PreprocessOptions()
        self.target, self.select_k, self.output = target, select_k, output

    def _fit(self, df):
        kept = []
        try:
            return self._fitted(df, kept)
        finally:
            for d in kept:
                d.unpersist()

    def _fitted(self, df, kept: list):
        """The fitted model; frames that it persists on the way go into ``kept``."""
        cfg, d = self.cfg, df
        stages = []
        feats = [c for c in self.features if c in df.columns]
        if cfg.ordinal_mappings:
            st = FT.OrdinalMapper(cfg.ordinal_mappings)
            stages.append(st)
            d = st.transform(d)
        nums0 = set(numeric_columns(d))
        cats = [c for c in feats if c not in nums0]
        hashed = []
        if cfg.hash_text and cats:
            hashed = [r["column"] for r in FT.auto_hash_columns(d, cats).where("hashed = 1").collect()]
            cats = [c for c in cats if c not in hashed]
        if cfg.freq_encode_high_card and cats:
            st = FT.FrequencyEncoder(threshold=cfg.high_card_threshold, cols=None, exclude=hashed, keyed=cfg.keyed).fit(d.select(*map(named, cats)))
            if st.state["cols"]:
                stages.append(st)
                d = st.transform(d)
                cats = [c for c in cats if c not in st.state["cols"]]
                # the passes below would hash every encoded text and join its frequency again
                d = d.select(*map(named, dict.fromkeys([*feats, *([self.target] if self.target in d.columns else [])]))).persist(StorageLevel.MEMORY_AND_DISK)
                kept.append(d)
        nums = [c for c in feats if c in set(numeric_columns(d)) and c not in hashed]
        binary, cont = [], []
        if nums:
            wide = at_least_distinct(d, nums, 3)
            for c in nums:
                (binary if c.startswith("MI__") or not wide[c] else cont).append(c)
        if nums:
            st = FT.NumericImputer(cols=nums, strategy=cfg.numeric_imputer).fit(d)
            stages.append(st)
            d = st.transform(d)
        if cfg.correlation_filter and len(nums) > 1:
            drop = [r["column"] for r in correlation_filter(d, nums, cfg.correlation_threshold).where("dropped = 1").collect()]
            st = FT.DropColumnsModel({"drop": sorted(drop)})
            stages.append(st)
            d = st.transform(d)
            cont, binary = ([c for c in x if c not in drop] for x in (cont, binary))
        if cont:
            if cfg.power_transform is True:
                pcols = cont
            elif cfg.power_transform == "auto":
                pcols = [r["column"] for r in skewness(d, cont).where("skewed = 1").collect()]
            else:
                pcols = []
            if pcols:
                st = FT.YeoJohnson(cols=pcols).fit(d)
                stages.append(st)
                d = st.transform(d)
            if self.family in (cfg.scale_for or []):
                st = FT.StandardScalerPop(cols=cont).fit(d)
                stages.append(st)
                d = st.transform(d)
            if cfg.drop_low_variance:
                st = FT.VarianceFilter(cols=cont, threshold=cfg.low_variance_threshold).fit(d)
                stages.append(st)
                d = st.transform(d)
                cont = [c for c in cont if c not in st.state["drop"]]
        cat_out, sparse = [], None
        if cats:
            st = FT.CategoricalImputer(cols=cats, strategy=cfg.categorical_imputer).fit(d)
            stages.append(st)
            d = st.transform(d)
            if cfg.rare_min_freq:
                st = FT.RareCategoryGrouper(min_freq=cfg.rare_min_freq, cols=cats).fit(d)
                stages.append(st)
                d = st.transform(d)
            if cfg.one_hot_for and self.family in cfg.one_hot_for:
                wide = at_least_distinct(d, cats, cfg.one_hot_columns + 1)
                if any(wide[c] for c in cats):
                    sparse = FT.SparseOneHot(cols=[c for c in cats if wide[c]]).fit(d)
                    cats = [c for c in cats if not wide[c]]
                st = FT.OneHot(cols=cats).fit(d)
                cat_out = st.output_columns()
            else:
                st = FT.OrdinalEncode(cols=cats).fit(d)
                cat_out = list(cats)
            stages.append(st)
            d = st.transform(d)
        names = cont + binary + cat_out
        if self.select_k and self.target and names:
            k = FT.clamp_k(int(self.select_k), len(names))
            top = FT.select_k_best_mi(d, names, self.target, k, task=self.task, estimator=cfg.select_k_by).collect()
            keep = {r["feature"] for r in top}
            names = [n for n in names if n in keep]
        hash_stage = None
        if hashed:
            hash_stage = FT.HashingEncoder(cols=hashed, n_features=cfg.hash_n_features, output="__hash").fit(d)
        model = PreprocessorModel(stages, names, self.output if not cfg.svd_components else WIDE, hash_stage, sparse=sparse)
        if cfg.svd_components:
            from .svd import TruncatedSVD
            model.svd = TruncatedSVD(k=cfg.svd_components, inputCol=WIDE, outputCol=self.output).fit(model.transform(df))
            model.state["output"] = self.output
        return model


def export_matrix(pre: PreprocessorModel, df: DataFrame, label: str, key: list[str] | None = None) -> DataFrame:
    """Preprocessed training matrix: key columns, ``y`` first among values, then one column per
    feature name (``f_i`` when names are not unique)."""
    from pyspark.ml.functions import vector_to_array
    out = pre.transform(df)
    names = pre.feature_names
    if len(set(names)) != len(names):
        names = [f"f_{i}" for i in range(len(names))]
    arr = vector_to_array(F.col(pre.state["output"]))
    return out.select(*(key or []), F.col(label).alias("y"), *[arr[i].alias(n) for i, n in enumerate(names)])


def align_columns(df: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """Reorder to the training columns: missing → typed NULL, extra columns dropped."""
    have = set(df.columns)
    return df.select(*[named(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in expected])


def feature_schema(df: DataFrame) -> DataFrame:
    """(position, column, dtype) of a frame — the persisted features schema."""
    return df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)],
                                           "position int, column string, dtype string")
