"""Image files in, PNG or BMP bytes and files out."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validators import image_error


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, n_channels, mode, data (rows of blue, green, red) of each image that can be decoded."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", F.col("image.nChannels").alias("n_channels"), "image.mode", "image.data")


def check_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, error of each file: extension and size."""
    return spark.read.format("binaryFile").load(path).select("path", "length", image_error(F.col("path"), F.col("length")).alias("error"))


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Red, green, blue from the rows of an image struct; grey becomes three channels and transparency goes."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[:, :, 2::-1].copy()


def to_png(image: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, width * 3)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def to_bmp(image: np.ndarray) -> bytes:
    """A 24-bit BMP: rows from the bottom up, blue, green, red, each row filled to four bytes."""
    height, width = image.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = np.ascontiguousarray(image[::-1, :, ::-1], np.uint8).reshape(height, width * 3)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


ENCODERS = {"PNG": to_png, "BMP": to_bmp}


def encode(image: np.ndarray, image_format: str = "PNG") -> bytes:
    """The bytes of an image file. Other formats need a library that isn't here."""
    if image_format.upper() not in ENCODERS:
        raise ValueError(f"unknown image format: {image_format}")
    return ENCODERS[image_format.upper()](image)


def save_image_files(df: DataFrame, folder: str, name: str, column: str = "png") -> None:
    """Write a binary column as files, one for each row, named by the column ``name``. ``folder``: a path or URI that all
    executors reach. A task that is run again writes the same files again."""

    def write(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{base}/{r[0]}") as f:
                f.write(bytes(r[1]))

    df.where(F.col(column).isNotNull()).select(name, column).foreachPartition(write)


def save_images(df: DataFrame, path: str, column: str = "png") -> None:
    """Write a binary column with the other columns as Parquet."""
    df.where(F.col(column).isNotNull()).write.mode("overwrite").parquet(path)
