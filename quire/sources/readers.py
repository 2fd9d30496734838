"""Readers of page files: recognised text, layouts, images, manifests."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import safe_name, strip

#: Fields of an item in a page's list.
ITEM = {
    "text": "string",
    "x1": "int",
    "y1": "int",
    "x2": "int",
    "y2": "int",
    "confidence": "double",
    "words": "array<string>",
    "word_boxes": "array<struct<x1:int,y1:int,x2:int,y2:int>>",
    "preserve_visual": "boolean",
    "_force_text": "boolean",
}

#: First bytes of the image and document types that are taken in.
MAGIC = {"png": "89504E47", "jpg": "FFD8FF", "jpeg": "FFD8FF", "pdf": "25504446", "webp": "52494646", "bmp": "424D", "gif": "47494638"}
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp")


def _name(path="_metadata.file_name"):
    return F.col(path)


def scan_items(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, idx, text, box, confidence, ...) of all ``page_*.ocr.json`` below a path; raw backups are left out.

    The list position becomes ``idx``, the page id comes from the file name. A
    file that isn't a list of items gives no rows.
    """
    files = spark.read.text(f"{path}/page_*.ocr.json", wholetext=True).select(_name().alias("file"), "value").where("not endswith(file, '.raw.json')")
    items = files.where("startswith(ltrim(value), '[')").select(F.regexp_extract("file", r"^page_(.+?)\.ocr\.json$", 1).alias("page_id"), F.posexplode(F.from_json("value", f"array<struct<{','.join(f'{k}:{v}' for k, v in ITEM.items())}>>")).alias("idx", "i"))
    return items.select("page_id", "idx", *[F.col(f"i.{k}").alias(k.lstrip("_")) for k in ITEM])


def scan_tolerant(pages: DataFrame, page: str = "page_id", value: str = "value") -> DataFrame:
    """Items of JSON texts that are a list, or an object with a list under items, results or ocr.

    Entries that are no object, have a blank text or a bad box are dropped; texts
    are trimmed. (page_id, idx, text, x1, y1, x2, y2, confidence); idx counts all
    entries of the list, dropped ones too.
    """
    v = F.try_parse_json(F.col(value))
    lists = [F.expr(f"try_variant_get(__v, '{p}', 'array<variant>')") for p in ("$", "$.items", "$.results", "$.ocr")]
    rows = pages.withColumn("__v", v).select(page, F.posexplode(F.coalesce(*lists)).alias("idx", "__i"))
    part = lambda p, t: F.expr(f"try_variant_get(__i, '$.{p}', '{t}')")
    out = rows.select(page, "idx", strip(part("text", "string")).alias("text"), *[part(c, "double").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.coalesce(part("confidence", "double"), F.lit(1.0)).alias("confidence"))
    return out.where("text <> '' and x2 > x1 and y2 > y1")


def flatten_predictions(preds: DataFrame, min_conf: float = 0.5) -> DataFrame:
    """Parallel arrays (texts, scores, polys, words) to rows (page_id, idx, text, box, confidence, words).

    A missing score is 1. Scores below ``min_conf`` and blank texts are dropped;
    a polygon becomes its bounding box; words stay only if they spell the text.
    """
    n = F.size("texts")
    rows = preds.select("page_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("idx"), "texts", "scores", "polys", "words").where("size(texts) > 0")
    at = lambda c: F.get(c, F.col("idx"))
    side = lambda f, i: f(F.transform(F.col("poly"), lambda p: F.get(p, F.lit(i))))
    rows = rows.select("page_id", "idx", at("texts").alias("text"), F.coalesce(at("scores"), F.lit(1.0)).alias("confidence"), at("polys").alias("poly"), at("words").alias("words"))
    rows = rows.where((F.col("confidence") >= min_conf) & (strip("text") != ""))
    good = F.array_join("words", "") == F.regexp_replace("text", " ", "")
    return rows.select("page_id", "idx", "text", side(F.array_min, 0).alias("x1"), side(F.array_min, 1).alias("y1"), side(F.array_max, 0).alias("x2"), side(F.array_max, 1).alias("y2"), "confidence", F.when(good, F.col("words")).alias("words"))


def glyphs_to_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs (page_id, line_id, i, ch, box) to lines in reading order: (page_id, idx, text, box, confidence).

    Space at the ends of a line goes. Space inside joins the glyph before it,
    whose right edge grows by half its width each time, by 1 at least.
    """
    key = ["page_id", "line_id"]
    one = F.struct("i", "ch", "x1", "y1", "x2", "y2")
    lines = glyphs.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("g"))
    empty = F.lit(None).cast("struct<text:string,pending:string,x1:int,y1:int,x2:int,y2:int,lx1:int,lx2:int>")

    def step(acc, g):
        blank = g["ch"].rlike(r"^\s*$")
        first = F.struct(g["ch"].alias("text"), F.lit("").alias("pending"), g["x1"].cast("int").alias("x1"), g["y1"].cast("int").alias("y1"), g["x2"].cast("int").alias("x2"), g["y2"].cast("int").alias("y2"), g["x1"].cast("int").alias("lx1"), g["x2"].cast("int").alias("lx2"))
        wider = acc["lx2"] + F.greatest(((acc["lx2"] - acc["lx1"]) / 2).cast("int"), F.lit(1))
        space = F.struct(acc["text"].alias("text"), F.concat(acc["pending"], g["ch"]).alias("pending"), acc["x1"].alias("x1"), acc["y1"].alias("y1"), acc["x2"].alias("x2"), acc["y2"].alias("y2"), acc["lx1"].alias("lx1"), wider.alias("lx2"))
        more = F.struct(
            F.concat(acc["text"], acc["pending"], g["ch"]).alias("text"),
            F.lit("").alias("pending"),
            F.least(acc["x1"], g["x1"].cast("int")).alias("x1"),
            F.least(acc["y1"], g["y1"].cast("int")).alias("y1"),
            F.greatest(acc["x2"], g["x2"].cast("int"), F.when(acc["pending"] != "", acc["lx2"])).alias("x2"),
            F.greatest(acc["y2"], g["y2"].cast("int")).alias("y2"),
            g["x1"].cast("int").alias("lx1"),
            g["x2"].cast("int").alias("lx2"),
        )
        return F.when(blank & acc.isNull(), empty).when(blank, space).when(acc.isNull(), first).otherwise(more)

    folded = lines.select(*key, F.aggregate("g", empty, step).alias("t")).where("t is not null")
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("t.y1", "t.x1", "line_id")) - 1
    return folded.select("page_id", number.alias("idx"), "t.text", "t.x1", "t.y1", "t.x2", "t.y2", F.lit(1.0).alias("confidence"))


def discover_pages(files: DataFrame, name: str = "name") -> DataFrame:
    """(page, page_id, name) of ``page_<n>.<image type>``, in numeric order; a page found twice fails the job.

    The id has two digits at least.
    """
    n = F.regexp_extract(F.col(name), r"^page_(\d+)\.(?i:png|jpg|jpeg|webp|bmp)$", 1)
    rows = files.select(F.col(name).alias("name"), n.alias("digits")).where("digits <> ''").withColumn("page", F.col("digits").cast("int"))
    one = rows.groupBy("page").agg(F.count("*").alias("times"), F.min("name").alias("name"))
    checked = F.when(F.col("times") > 1, F.raise_error(F.format_string("page %d is there twice", "page"))).otherwise(F.col("page"))
    text = F.col("page").cast("string")
    return one.select(checked.alias("page"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text).alias("page_id"), "name").orderBy("page")


def page_select(pages: DataFrame, wanted: str, page: str = "page") -> DataFrame:
    """The pages of a list like "3,1,2", in that order (column ``position``); a number out of range fails."""
    numbers = [int(x) for x in wanted.split(",") if x.strip()]
    spark = pages.sparkSession
    chosen = spark.createDataFrame([(n, i) for i, n in enumerate(numbers)], f"{page} int, position int")
    both = F.broadcast(chosen).join(pages.withColumn("__there", F.lit(True)), page, "left")
    checked = F.when(F.col("__there").isNull(), F.raise_error(F.format_string("no page %d", page))).otherwise(F.col("position"))
    return both.withColumn("position", checked).drop("__there").orderBy("position")


def renumber_pages(files: DataFrame, name: str = "name") -> DataFrame:
    """Files of one job by name as page_01, page_02, ...; ``job`` groups them."""
    n = F.row_number().over(Window.partitionBy("job").orderBy(name))
    return files.withColumn("page", n).withColumn("page_name", F.format_string("page_%02d", n))


def scan_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(file, layout) of ``*.layout.json``, combined ones left out; page files only, where there are any."""
    rows = spark.read.text(f"{path}/*.layout.json", wholetext=True).select(_name().alias("file"), F.col("value").alias("layout")).where("not startswith(file, 'combined.')")
    pages = rows.where("startswith(file, 'page_')")
    return pages if pages.limit(1).count() else rows


def walk_text(docs: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, path, text): every string under a key ``text``, at any level of JSON texts; goes on until a level is empty."""
    level = docs.select(*key, F.lit("").alias("path"), F.try_parse_json(F.col(value)).alias("v"), F.lit(None).cast("string").alias("name"))
    found = None
    for i in count():
        level.createOrReplaceTempView(f"__walk_{i}")
        names = ", ".join(f"t.{k}" for k in key)
        level = docs.sparkSession.sql(f"select {names}, concat(t.path, '/', coalesce(e.key, cast(e.pos as string))) as path, e.value as v, e.key as name from __walk_{i} t, lateral variant_explode(t.v) e")
        hit = level.where("name = 'text' and schema_of_variant(v) = 'STRING'").select(*key, "path", F.expr("try_variant_get(v, '$', 'string')").alias("text"))
        found = hit if found is None else found.union(hit)
        level = level.where("not (coalesce(name, '') = 'text' and schema_of_variant(v) = 'STRING')")
        if not level.limit(1).count():
            return found


def source_ref_text(items: DataFrame, key: str = "job") -> DataFrame:
    """(key, text): the texts of all pages, in page and list order, a line each; nothing for keys without text."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "idx", "text"))), lambda s: s["text"])
    return items.where("text is not null").groupBy(key).agg(F.array_join(listed, "\n").alias("text"))


def classify_upload(files: DataFrame, job: str = "job", name: str = "name") -> DataFrame:
    """(job, kind, page_count): pdf for one PDF alone, image for one image, dir for several, else reject."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.([^.]+)$", 1))
    agg = files.groupBy(job).agg(F.count_if(ext.isin(*IMAGES)).alias("images"), F.count_if(ext == "pdf").alias("pdfs"), F.count("*").alias("n"))
    one_pdf, only = (F.col("pdfs") == 1) & (F.col("images") == 0), F.col("pdfs") == 0
    kind = F.when(one_pdf, "pdf").when(only & (F.col("images") == 1), "image").when(only & (F.col("images") > 1), "dir").otherwise("reject")
    return agg.select(job, kind.alias("kind"), F.when(kind == "reject", 0).when(kind == "pdf", F.lit(None)).otherwise(F.col("images")).cast("long").alias("page_count"))


def magic_check(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``files`` with ``magic_ok``: the first bytes fit the extension; an unknown extension doesn't."""
    ext = F.lower(F.regexp_extract(F.col(name), r"\.([^./]+)$", 1))
    wanted = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])[ext]
    head = F.hex(F.substring(F.col(content), 1, 12))
    webp = (ext != "webp") | (F.substring(head, 17, 8) == "57454250")
    return files.withColumn("magic_ok", F.coalesce(F.startswith(head, wanted) & webp, F.lit(False)))


def archive_guard(entries: DataFrame, archive: str = "archive", most_entries: int = 500, most_bytes: int = 200 << 20) -> DataFrame:
    """(archive, entries, bytes, unsafe, ok) of manifests (archive, name, size, mode): counts, sizes, names and links."""
    n = F.col("name")
    bad_name = n.rlike(r"(^|/)\.\.(/|$)") | F.contains(n, F.lit("\\")) | F.contains(n, F.lit(":")) | F.startswith(n, F.lit("/"))
    link = F.shiftright(F.coalesce("mode", F.lit(0)), 12).bitwiseAND(F.lit(15)) == 10
    agg = entries.groupBy(archive).agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.count_if(bad_name | link).alias("unsafe"))
    return agg.withColumn("ok", (F.col("entries") <= most_entries) & (F.col("bytes") <= most_bytes) & (F.col("unsafe") == 0))


def upload_caps(files: DataFrame, job: str = "job", each: int = 20 << 20, total: int = 100 << 20, count: int = 60) -> DataFrame:
    """(job, violation): the first rule broken in upload order (file_size, total_size, file_count), null if none."""
    w = Window.partitionBy(job).orderBy("pos")
    rule = F.when(F.row_number().over(w) > count, "file_count").when(F.col("size") > each, "file_size").when(F.sum("size").over(w) > total, "total_size")
    return files.withColumn("rule", rule).groupBy(job).agg(F.min_by("rule", F.when(F.col("rule").isNotNull(), F.col("pos"))).alias("violation"))


def safe_names(files: DataFrame, name: str = "name") -> DataFrame:
    return files.withColumn("safe_name", safe_name(name))
