"""YAML documents of cameras and regions, one for each frame of a film, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.config import Camera, Document, Projection


def frame_name(frame: Column) -> Column:
    """frame_0007 for 7; more digits where they are needed."""
    return F.format_string("frame_%04d", frame)


def _number(x, digits: int) -> Column:
    """A number in plain decimals: YAML takes 1.0E10 for text."""
    return F.format_string(f"%.{digits}f", x if isinstance(x, Column) else S.lit(x))


def _list(values, digits: int) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *(_number(v, digits) for v in values)), F.lit("]"))


def _lines(entries: dict[str, Column], indent: str = "") -> Column:
    return F.concat(*(F.concat(F.lit(f"{indent}{k}: "), v, F.lit("\n")) for k, v in entries.items()))


def camera_text(camera: Camera, projections: list[Projection] | None = None, digits: int = 9, **instead) -> Column:
    """The document of a camera. What changes from frame to frame comes from columns: position, look_at and up as three
    columns each, ortho_width, fov and slab as one, by keyword; the rest is taken from `camera`. Numbers have `digits`
    decimals. A null in one of the columns leaves the document null."""
    get = lambda name: instead.get(name, getattr(camera, name))
    own = {
        "type": F.lit(camera.kind),
        "position": _list(get("position"), digits),
        "look_at": _list(get("look_at"), digits),
        "up": _list(get("up"), digits),
        "fov": _number(get("fov"), digits),
        "ortho_width": _number(get("ortho_width"), digits),
        "los_slab": _number(get("slab"), digits),
        "image_width": F.lit(str(camera.width)),
        "image_height": F.lit(str(camera.height)),
    }
    asked = "".join(f"  - field: {p.field}\n    mode: {p.mode}\n" for p in projections or [Projection()])
    given = [c for v in instead.values() for c in (v if isinstance(v, (list, tuple)) else [v]) if isinstance(c, Column)]
    whole = F.concat(F.lit("camera:\n"), _lines(own, "  "), F.lit("projections:\n" + asked))
    for c in given:
        whole = F.when(c.isNotNull(), whole)
    return whole


def region_text(name: Column, center: list[Column], radius: Column, kinds: tuple[str, ...] = ("gas",), digits: int = 9) -> Column:
    """The document of a round region."""
    own = {"name": name, "center": _list(center, digits), "radius": _number(radius, digits), "particle_types": F.lit(f"[{', '.join(kinds)}]")}
    return _lines(own)


def write_documents(rows: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder `name=...` a document, each with one text file that ends with one line feed; rows without a document
    are left out. Names must differ. A film's frames are few, so each task writes some hundred small files at most."""
    kept = rows.where(F.col(text).isNotNull()).select(F.col(name).alias("name"), F.regexp_replace(F.col(text), r"\n\z", "").alias("value"))
    kept.write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of a folder of documents."""
    if "name" not in spark.read.text(path, wholetext=True).columns:  # no document was written
        return spark.createDataFrame([], "name string, text string")
    found = spark.read.schema("value string, name string").text(path, wholetext=True)
    return found.select("name", F.col("value").alias("text"))


def read_cameras(spark: SparkSession, path: str) -> dict[str, Camera]:
    """A film's cameras by name, in order of name. Their number is that of the frames, so they go to the driver."""
    rows = read_documents(spark, path).orderBy("name").toLocalIterator()
    return {r["name"]: Document.parse(r["text"]).camera() for r in rows}


def write_list(rows: DataFrame, path: str, name: str = "name", folder: str = "") -> None:
    """A camera list: one line a document, in order of name, in one file."""
    lead = F.lit(f"{folder.rstrip('/')}/") if folder else F.lit("")
    lines = rows.select(F.concat(lead, F.col(name)).alias("value"), F.col(name).alias("name"))
    lines.coalesce(1).sortWithinPartitions("name").select("value").write.mode("overwrite").text(path)
