"""Readers for the engine's nested JSON, CSV, log, manifest and image inputs. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ACTION = "struct<action_type_id:int,action_type_text:string,touch:array<double>,lift:array<double>,type_text:string,annot_position:array<double>>"
STEP = f"struct<ep_id:string,img_filename:string,goal:string,action_list:array<{ACTION}>>"
QA_FIELDS = "q_uid:string,uid:string,question:string,`option 0`:string,`option 1`:string,`option 2`:string,`option 3`:string,`option 4`:string,truth:int"


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of each file."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def steps(texts: DataFrame, col: str = "text") -> DataFrame:
    """{task: [[step, ...], ...]} to a row per step, positions kept."""
    tasks = texts.select(F.explode(F.from_json(col, f"map<string,array<array<{STEP}>>>")).alias("task", "episodes"))
    eps = tasks.select("task", F.posexplode("episodes").alias("ep_pos", "steps"))
    return eps.select("task", "ep_pos", F.posexplode("steps").alias("step_idx", "s")).select("task", "ep_pos", "step_idx", "s.*")


def questions(texts: DataFrame, col: str = "text") -> DataFrame:
    """Annotations as {uid: item} or [item, ...] to (qid, question, options, truth); a missing truth is -1."""
    item = f"struct<{QA_FIELDS}>"
    listed = F.trim(F.col(col)).startswith("[")
    a = texts.where(~listed).select(F.explode(F.from_json(col, f"map<string,{item}>")).alias("key", "q"))
    b = texts.where(listed).select(F.explode(F.from_json(col, f"array<{item}>")).alias("q")).select(F.coalesce("q.q_uid", "q.uid").alias("key"), "q")
    q = a.unionByName(b)
    return q.select(F.col("key").alias("qid"), "q.question", F.array(*(F.col(f"q.`option {i}`") for i in range(5))).alias("options"), F.coalesce("q.truth", F.lit(-1)).alias("truth"))


def question_table(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Question rows of CSV or Parquet files (a glob or a folder, searched in depth), ids put together."""
    schema = "video string, frame_count int, width int, height int, question string, answer int, qid string, type string, a0 string, a1 string, a2 string, a3 string, a4 string"
    r = spark.read.schema(schema).option("recursiveFileLookup", "true")
    q = r.option("header", "true").csv(path) if fmt == "csv" else r.parquet(path)
    return q.select(F.concat_ws("_", "video", "qid").alias("qid"), F.col("video").alias("video_id"), "question", F.array("a0", "a1", "a2", "a3", "a4").alias("options"), "answer", F.col("type").alias("q_type"))


def captions(texts: DataFrame, col: str = "text") -> DataFrame:
    """{video: [caption, ...]} to (video_id, idx from 1, caption)."""
    v = texts.select(F.explode(F.from_json(col, "map<string,array<string>>")).alias("video_id", "c"))
    return v.select("video_id", F.posexplode("c").alias("pos", "caption")).select("video_id", (F.col("pos") + 1).alias("idx"), "caption")


def manifest(texts: DataFrame, col: str = "text") -> DataFrame:
    v = texts.select(F.explode(F.from_json(col, "map<string,array<struct<path:string,task:string,title:string,id:string>>>")).alias("domain", "items"))
    return v.select("domain", F.explode("items").alias("i")).select("domain", "i.*")


#: The line heads of an evaluation log, and the action classes of its table.
OVERALL_SCORE = r"\[Overall Avg Score\]:\s*([\d.]+)"
OVERALL_TYPE_ACC = r"Overall Type Acc\s*\|\s*([\d.]+)"
EPISODE_COMPLETION = r"Avg Episode Completion\s*:\s*([\d.]+)"
IMAGES_PER_STEP = r"Avg Images Per Step\s*:\s*([\d.]+)"
TOTAL_STEPS = r"Total Steps\s*\|\s*(\d+)"
CLASSES = ["CLICK", "SCROLL", "TYPE", "PRESS", "ZOOM", "FINISH"]


def log_metrics(text: Column) -> list[Column]:
    """Accuracies, completion, images and steps of a run's log, and count, score and type accuracy of each class; the first
    match of each line counts, null where a line is missing."""
    number = lambda p, i=1, kind="double": F.regexp_extract(text, p, i).try_cast(kind)
    out = [number(OVERALL_SCORE).alias("acc"), number(OVERALL_TYPE_ACC).alias("type_acc"), number(EPISODE_COMPLETION).alias("completion"), number(IMAGES_PER_STEP).alias("images"), number(TOTAL_STEPS, kind="int").alias("total_steps")]
    for c in CLASSES:
        row = rf"{c}\s*\|\s*(\d+)\s*\|\s*([\d.]+)\s*\|\s*([\d.]+)"
        out += [number(row, 1, "int").alias(f"{c.lower()}_count"), number(row, 2).alias(f"{c.lower()}_score"), number(row, 3).alias(f"{c.lower()}_type_acc")]
    return out


def path_parts(path: Column) -> list[Column]:
    """(model, mode) of .../model/mode/file; a _no_cut suffix is told apart."""
    mode = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    return [F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("model"), F.regexp_replace(mode, "_no_cut$", "").alias("mode"), mode.endswith("_no_cut").alias("no_cut")]


#: The two modes of a leaderboard.
BASE_MODE, VIDEO_MODE = "single", "uniform10"


def run_folder(path: Column) -> list[Column]:
    """(model, mode) of .../model_mode/run.log for the two modes; null for other folders."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    known = rf"^(.+)_({BASE_MODE}|{VIDEO_MODE})$"
    part = lambda i: F.nullif(F.regexp_extract(folder, known, i), F.lit(""))
    return [part(1).alias("model"), part(2).alias("mode")]


def tag(name: Column) -> Column:
    """A model's name as part of a path: slashes, blanks and colons as underscores."""
    return F.translate(name, "/ :", "___")


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """(model, mode, metrics...) of the run.log in each run's folder below ``root``; logs without any metric are left out."""
    logs = whole_files(spark, f"{root}/*/run.log")
    some = "|".join(f"(?:{p})" for p in (OVERALL_SCORE, OVERALL_TYPE_ACC, EPISODE_COMPLETION, IMAGES_PER_STEP, TOTAL_STEPS))
    logs = logs.where(F.col("path").rlike(rf"_({BASE_MODE}|{VIDEO_MODE})/[^/]+$") & F.col("text").rlike(some))
    return logs.select(*run_folder(F.col("path")), *log_metrics(F.col("text")))


def run_results(spark: SparkSession, root: str) -> DataFrame:
    """(method, dataset, accuracy, avg_frames, error) of root/method/dataset/results.json; folders of checkpoints are left out,
    and files that don't read as JSON are marked, not dropped."""
    files = whole_files(spark, f"{root}/*/*/results.json")
    path = F.col("path")
    rows = files.select(F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1).alias("method"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("dataset"), "text")
    value = lambda name, kind: F.get_json_object("text", f"$.{name}").try_cast(kind)
    bad = F.try_parse_json("text").isNull() | F.get_json_object("text", "$.error").isNotNull()
    rows = rows.where(~F.col("method").endswith("_checkpoint"))
    return rows.select("method", "dataset", value("accuracy_pct", "string").alias("accuracy"), value("avg_frames", "double").alias("avg_frames"), bad.alias("error"))


def named(rows: DataFrame, names: dict[str, str], col: str = "method") -> DataFrame:
    """``rows`` with display, the name to show for ``col``; a name that isn't known is shown as it is."""
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    return rows.withColumn("display", F.coalesce(F.try_element_at(known, F.col(col)), F.col(col)))


def splits(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet rows of all splits, root/split/*.parquet, with the split's name."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/*")
    return rows.withColumn("split", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def example_text(spark: SparkSession, path: str) -> str:
    """A whole small text file, such as an example that goes into every prompt."""
    return whole_files(spark, path).first()["text"]


def narrated(annotations: DataFrame, narrations: DataFrame, durations: DataFrame, key: str = "video_id") -> DataFrame:
    """Annotations with the narration and duration of their video; those without narration are left out, and one whose
    duration is missing ends the run."""
    rows = annotations.join(narrations.select(key, "narration"), key).join(durations.select(key, F.col("duration").cast("int").alias("duration_")), key, "left")
    known = F.when(F.col("duration_").isNull(), F.raise_error(F.concat(F.lit("no duration for "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("duration_"))
    return rows.withColumn("duration", known).drop("duration_")


def narration(captions: Column, every: int | None = None) -> Column:
    """Captions as one text: joined by ". ", or each ``every``-th with the index it stands at, a line each."""
    if every is None:
        return F.array_join(captions, ". ")
    kept = F.filter(F.transform(captions, lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["i"] % every == 0)
    return F.array_join(F.transform(kept, lambda x: F.concat(x["i"].cast("string"), F.lit(": "), x["c"])), ".\n")


def reference_folder(mode: Column, no_cut: Column) -> Column:
    """The folder of a mode's reference images: none for the base mode, the annotated ones for gt, uniform_N for uniformN, otherwise
    the mode's own name; _no_cut is put behind it for whole recordings."""
    folder = F.when(mode == BASE_MODE, F.lit(None).cast("string")).when(mode == "gt", F.lit("annotation")).otherwise(F.regexp_replace(mode, r"^uniform(\d+)$", "uniform_$1"))
    return F.when(no_cut, F.concat(folder, F.lit("_no_cut"))).otherwise(folder)


def reference_images(mode: Column, folder: Column, own: Column, most: int = 10) -> Column:
    """The reference images of a step: none in the base mode, the step's own annotated image (if there is one) for gt, an even
    sample of the folder's for annotation, else all of the folder's, by name."""
    images = F.array_sort(F.coalesce(folder, F.array().cast("array<string>")))
    n = F.size(images)
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(images, F.bround(i * (n - 1) / (most - 1)).cast("int")))
    none = F.array().cast("array<string>")
    return F.when(mode == BASE_MODE, none).when(mode == "gt", F.when(own.isNull(), none).otherwise(F.array(own))).when((mode == "annotation") & (n > most), spread).otherwise(images)


def call_images(references: Column, target: Column) -> Column:
    """The images of a call: references first, the step's own screen last."""
    return F.concat(F.coalesce(references, F.array().cast("array<string>")), F.array(target))


def images(spark: SparkSession, root: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """(video_id, name, path) of images below ``root``, without reading their content."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path")
    return f.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("video_id"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path").orderBy("video_id", "name")


def local_videos(spark: SparkSession, root: str) -> DataFrame:
    """(video_id): the stems of the recordings in a folder."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(root).select("path")
    return f.select(F.regexp_extract("path", r"([^/]+)\.mp4$", 1).alias("video_id"))


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists in its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def data_url(name: Column, content: Column) -> Column:
    """Binary content as a data URL, its type by the name's ending."""
    end = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(end == "png", "image/png").when(end == "webp", "image/webp").when(end == "gif", "image/gif").otherwise("image/jpeg")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
