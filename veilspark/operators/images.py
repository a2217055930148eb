"""Redaction of personal data in images: text recognition, detection, covering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..config import PiiConfig
from ..functions.spans import no_spans
from ..plans.pipeline import resolved_spans
from ..sources.images import ENCODERS, encode, to_array
from .geometry import merge_adjacent, unite
from .mosaic import STYLES, cover
from .recognizers import scan

BOX = "struct<text:string,left:int,top:int,width:int,height:int>"
OCR = f"struct<text:string,boxes:array<{BOX}>,confidence:double>"
#: The entities of an image: text is that of the whole box.
IMAGE_ENTITY = "struct<entity_type:string,text:string,left:int,top:int,width:int,height:int,score:double>"
Engine = Callable[[object], object]


def _extent(points) -> tuple[int, int, int, int]:
    """left, top, width, height of a polygon or of left, top, right, bottom."""
    flat = [tuple(p) for p in points] if points is not None and len(points) and hasattr(points[0], "__len__") else None
    if flat:
        xs, ys = [p[0] for p in flat], [p[1] for p in flat]
        return int(min(xs)), int(min(ys)), int(max(xs) - min(xs)), int(max(ys) - min(ys))
    if points is not None and len(points) == 4:
        return int(points[0]), int(points[1]), int(points[2] - points[0]), int(points[3] - points[1])
    return 0, 0, 0, 0


def parse_ocr(raw) -> dict:
    """text, boxes and mean confidence from what engines return: an object or dict with rec_texts, rec_scores and boxes
    or polygons, or a list of such, of dicts with text, or of [polygon, (text, score)]. Blank texts are skipped."""
    found: list[tuple[str, tuple[int, int, int, int], float]] = []

    def field(x, name):
        return x.get(name) if isinstance(x, dict) else getattr(x, name, None)

    def first(x, *names):
        return next((v for v in (field(x, n) for n in names) if v is not None), None)

    def take(x) -> None:
        texts = field(x, "rec_texts") if not isinstance(x, (list, tuple)) else None
        if texts is not None:
            scores, places = field(x, "rec_scores"), first(x, "rec_boxes", "rec_polys", "dt_polys")
            for i, t in enumerate(texts):
                found.append((t, _extent(places[i] if places is not None and i < len(places) else None), float(scores[i]) if scores is not None and i < len(scores) else 0.0))
        elif isinstance(x, dict):
            rec = x.get("rec") or x
            place = first(x, "box", "bbox", "points")
            found.append((rec.get("text") or "", _extent(place), float(rec.get("conf", rec.get("score", rec.get("confidence", 0.0))) or 0.0)))
        elif isinstance(x, (list, tuple)) and len(x) == 2 and isinstance(x[1], (list, tuple)) and x[1] and isinstance(x[1][0], str):
            found.append((x[1][0], _extent(x[0]), float(x[1][1]) if len(x[1]) > 1 else 0.0))
        elif isinstance(x, (list, tuple)):
            for y in x:
                take(y)

    if raw is not None:
        take(raw)
    kept = [(t, b, c) for t, b, c in found if t and t.strip()]
    boxes = [{"text": t, "left": b[0], "top": b[1], "width": b[2], "height": b[3]} for t, b, _ in kept]
    return {"text": "\n".join(t for t, _, _ in kept), "boxes": boxes, "confidence": sum(c for _, _, c in kept) / len(kept) if kept else 0.0}


def with_ocr(images: DataFrame, make_engine: Callable[[], Engine], out: str = "ocr") -> DataFrame:
    """``images`` (height, width, n_channels, data) with the recognized text. ``make_engine`` runs once in each worker;
    an image it fails on gets null."""

    @F.pandas_udf(OCR)
    def recognize(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        engine = make_engine()
        for data, height, width, channels in parts:
            rows = []
            for d, h, w, c in zip(data, height, width, channels, strict=True):
                try:
                    rows.append(parse_ocr(engine(to_array(d, h, w, c))))
                except Exception:  # noqa: BLE001  one bad image must not fail the job
                    rows.append({"text": None, "boxes": None, "confidence": None})
            yield pd.DataFrame(rows, columns=["text", "boxes", "confidence"])

    return images.withColumn(out, recognize("data", "height", "width", "n_channels"))


def _lines(boxes: pd.Series) -> pd.Series:
    names = ("text", "left", "top", "width", "height")
    return pd.Series([[dict(zip(names, b, strict=True)) for b in merge_adjacent([tuple(x[n] for n in names) for x in (bs if bs is not None else [])])] for bs in boxes])


def _entities(images: DataFrame, config: PiiConfig, ocr: str, line_ok: Callable[[Column], Column] | None, span_ok: Callable[[Column], Column] | None = None, explicit: Column | None = None) -> DataFrame:
    plain = config.replace(allow_list=())

    def of_line(b: Column) -> Column:
        def settled(s: Column) -> Column:
            s = F.filter(s, span_ok) if span_ok else s
            return F.when(F.size(s) > 0, resolved_spans(b["text"], s, plain, explicit)).otherwise(no_spans())

        spans = F.flatten(F.transform(F.array(scan(b["text"], plain)), settled))  # a step of its own for what is scanned, so that it is scanned once
        return F.transform(spans, lambda s: F.struct(s["entity_type"], b["text"], b["left"], b["top"], b["width"], b["height"], s["score"]).cast(IMAGE_ENTITY))

    found = images.withColumn("_lines", F.pandas_udf(_lines, f"array<{BOX}>")(f"{ocr}.boxes"))
    wanted = F.filter("_lines", line_ok) if line_ok else F.col("_lines")
    return found.withColumn("pii_entities", F.flatten(F.transform(wanted, of_line))).drop("_lines")


def image_entities(images: DataFrame, config: PiiConfig | None = None, ocr: str = "ocr") -> DataFrame:
    """``images`` with the entities of its text lines (pii_entities). Allowed texts are whole lines; each line's text is
    analysed by itself and its whole box counts. Lines stay in the row of their image: no pixel is shuffled."""
    config = config or PiiConfig()
    return _entities(images, config, ocr, (lambda b: ~b["text"].isin(list(config.allow_list))) if config.allow_list else None)


def requested_image_entities(requests: DataFrame, config: PiiConfig | None = None, ocr: str = "ocr") -> DataFrame:
    """:func:`image_entities` for requests whose rows say what they want, in columns that may be missing or null: entities
    (array of types), allow_list (array of lines) and score_threshold."""
    col = lambda name: F.col(name) if name in requests.columns else None
    allowed, types = col("allow_list"), col("entities")
    line_ok = (lambda b: F.coalesce(~F.array_contains(allowed, b["text"]), F.lit(True))) if allowed is not None else None
    span_ok = (lambda s: types.isNull() | F.array_contains(types, s["entity_type"])) if types is not None else None
    return _entities(requests, config or PiiConfig(), ocr, line_ok, span_ok, col("score_threshold"))


def _painted(images: DataFrame, padding: int, out: str, image_format: str, style: str | None, options: dict) -> DataFrame:
    """``style`` None: each row has its own mosaic_style and fill_color."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda name, b=b: b.column(b.schema.get_field_index(name)) if name in b.schema.names else [pa.scalar(None)] * b.num_rows
            done = []
            for d, h, w, c, es, own, colour in zip(*[col(n) for n in ("data", "height", "width", "n_channels", "pii_entities", "mosaic_style", "fill_color")], strict=True):
                kind, how = style, options
                if style is None:
                    kind, rgb = own.as_py() or "pixel", colour.as_py()
                    whole = rgb is not None and len(rgb) == 3 and all(v is not None and 0 <= v <= 255 for v in rgb)
                    how = {"fill_color": tuple(rgb)} if kind == "fill" and whole else {}
                    if kind not in STYLES or (rgb is not None and not whole):
                        done.append(None)  # a bad request must not fail the job
                        continue
                areas = unite([(e["left"], e["top"], e["width"], e["height"]) for e in es.as_py() or []], padding)
                done.append(encode(cover(to_array(d.as_py(), h.as_py(), w.as_py(), c.as_py()), areas, kind, **how), image_format))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.binary())], names=[*b.schema.names, out])

    if image_format.upper() not in ENCODERS:
        raise ValueError(f"unknown image format: {image_format}")
    return images.mapInArrow(paint, StructType([*images.schema.fields, StructField(out, BinaryType())]))


def redact(images: DataFrame, style: str = "pixel", padding: int = 5, out: str = "png", image_format: str = "PNG", **options) -> DataFrame:
    """``images`` with the bytes of an image file in which the boxes of pii_entities are covered; without entities the
    image as it is."""
    if style not in STYLES:
        raise ValueError(f"unknown mosaic style: {style}")
    return _painted(images, padding, out, image_format, style, options)


def redact_requests(requests: DataFrame, padding: int = 5, out: str = "png", image_format: str = "PNG") -> DataFrame:
    """:func:`redact` in the mosaic_style (null: pixel) and, for fill, the fill_color (red, green, blue; null: black) of
    each row. An unknown style or a colour that is none gives null."""
    return _painted(requests, padding, out, image_format, None, {})
