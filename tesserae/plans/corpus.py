"""Loading of train and eval records: user sequences, or product prompts from two kinds of metadata."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import items as im
from tesserae.operators.negatives import sequence_records
from tesserae.operators.splits import EVAL_RATIO, SPLIT_SEED, sequence_eval_size, split
from tesserae.sources import artifacts, loose, structured
from tesserae.workspace import store

# The names under which a configuration file gives each setting, where they differ from ours.
CONFIG_NAMES = {
    "mode": "dataset_mode",
    "version": "dataset_version",
    "ratio": "eval_split_ratio",
    "max_total": "max_total_samples",
    "max_train": "max_train_samples",
    "max_eval": "max_eval_samples",
    "max_chars": "max_num_chars",
    "artifact_dir": "sequential_dir",
    "metadata_file": "filename_template",
    "restrict": "restrict_to_datamaps",
}
SEQUENTIAL = "sequential"
NO_NEGATIVES = "category string, user_id string, chunk_no bigint, neg_items array<string>"


@dataclass(frozen=True)
class Settings:
    """What to load and how to split it. ``restrict`` of None restricts exactly if there are artifacts."""

    categories: tuple[str, ...] = ()
    mode: str = "metadata"
    version: str = "2023"
    seed: int = SPLIT_SEED
    ratio: float = EVAL_RATIO
    max_total: int | None = None
    max_train: int | None = None
    max_eval: int | None = None
    max_chars: int = im.MAX_CHARS
    feature_probability: float = im.FEATURE_PROBABILITY
    codebook_size: int = im.CODEBOOK_SIZE
    codebook_range: int = im.CODEBOOK_RANGE
    metadata_dir: str | None = None
    metadata_file: str = loose.METADATA_FILE
    artifact_dir: str | None = None
    partitioned_artifacts: bool = True
    restrict: bool | None = None
    product_paths: Mapping[str, str] | None = None
    product_format: str = "json"

    @classmethod
    def of(cls, config: Mapping | Settings) -> Settings:
        """Settings from a configuration mapping; keys that name no setting are ignored."""
        if isinstance(config, cls):
            return config
        given = {}
        for field in fields(cls):
            key = CONFIG_NAMES.get(field.name, field.name)
            if key in config and (config[key] is not None or field.default is None):
                given[field.name] = config[key]
        names = given.get("categories") or ([config["category"]] if config.get("category") else [])
        return cls(**given | {"categories": tuple(names), "version": str(given.get("version", cls.version))})

    def __post_init__(self):
        if not self.categories:
            raise ValueError("no category given: set categories or category")

    def artifact_folder(self, purpose: str) -> str:
        if not self.artifact_dir:
            raise ValueError(f"{purpose} needs sequential_dir, the artifact folder")
        return self.artifact_dir

    def allowed_items(self, spark: SparkSession) -> DataFrame | None:
        """The items that products are restricted to, or None for all."""
        if self.restrict is False or (self.restrict is None and not self.artifact_dir):
            return None
        folder = self.artifact_folder("restrict_to_datamaps")
        return artifacts.read_item_ids(spark, folder, list(self.categories), self.partitioned_artifacts)

    def split(self, rows: DataFrame, key: list[str], **more) -> DataFrame:
        return split(
            rows, key, seed=self.seed, ratio=self.ratio,
            max_total=self.max_total, max_train=self.max_train, max_eval=self.max_eval, **more,
        )


def prompt_records(items: DataFrame, settings: Settings, by_category: bool = False) -> DataFrame:
    """Splits items by a digest of what they hold, and adds each row's text and chats from its split index.

    Input positions depend on how files are cut, so they play no part: equal rows are
    interchangeable, and a row goes to the same side however it is stored. ``by_category`` splits
    every category on its own instead of the merged rows.
    """
    content = F.to_json(F.struct(*sorted(c for c in items.columns if c != "seq")), {"ignoreNullFields": "false"})
    items = store(items.withColumn("content", F.sha2(content, 256)), "items")
    placed = settings.split(items, ["content"], group=["category"] if by_category else []).drop("content")
    texts = im.with_text(placed, "index", settings.seed, settings.max_chars, settings.feature_probability)
    return im.with_prompts(texts, "index", settings.codebook_size, settings.codebook_range)


def loose_items(metadata: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Normalised products, restricted to the ``allowed`` (category, item) rows if given."""
    return im.normalize(metadata if allowed is None else im.align(metadata, allowed))


def split_sequences(sequences: DataFrame, negatives: DataFrame | None, settings: Settings) -> DataFrame:
    """``category, user_id, chunk_no, item_ids, neg_items, split, index``; a user is on one side as a whole."""
    if negatives is None:
        negatives = sequences.sparkSession.createDataFrame([], NO_NEGATIVES)
    user = ["category", "user_id"]
    sides = settings.split(sequences.select(*user).distinct(), user, eval_size=sequence_eval_size)
    return sequence_records(sequences, negatives, sides)


def item_corpus(spark: SparkSession, config: Mapping | Settings) -> DataFrame:
    """Products of the dict-literal metadata files of all categories."""
    settings = Settings.of(config)
    paths = loose.category_paths(settings.metadata_dir, list(settings.categories), settings.metadata_file)
    allowed = settings.allowed_items(spark)
    return loose_items(loose.read_metadata(spark, paths), allowed)


def sequence_corpus(spark: SparkSession, config: Mapping | Settings) -> DataFrame:
    """Records of the sequence and negative artifacts of all categories."""
    settings = Settings.of(config)
    where = settings.artifact_folder("sequential mode"), list(settings.categories), settings.partitioned_artifacts
    sequences = store(artifacts.read_sequences(spark, *where), "sequences")
    return split_sequences(sequences, artifacts.read_negatives(spark, *where), settings)


def product_corpus(spark: SparkSession, config: Mapping | Settings) -> DataFrame:
    """Products of structured files of all categories."""
    settings = Settings.of(config)
    products = structured.read_products(spark, dict(settings.product_paths or {}), settings.product_format)
    return products.filter(F.col("category").isin(*settings.categories))


def load_corpus(spark: SparkSession, config: Mapping | Settings) -> DataFrame:
    """Records of the configured mode, split into train and eval."""
    settings = Settings.of(config)
    if settings.mode == SEQUENTIAL:
        return sequence_corpus(spark, settings)
    read = {"2014": item_corpus}.get(settings.version, product_corpus)
    return prompt_records(read(spark, settings), settings)
