"""Image files as a Spark data source: PNM, BMP and JPEG read as rasters, and rasters written a file each.

spark.read.format("rasters").option("bits", "8").load(folder) gives path, width, height, components, values and error;
a file that fails gives a row with its error. rasters.write.format("rasters").option("kind", "bmp").save(folder)
writes image_id.bmp, and .pgm, .ppm or .jpg by kind and components.
"""

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tesserae.operators import codec, faults
from tesserae.sources import files

KINDS = (".pgm", ".ppm", ".pnm", ".bmp", ".jpg", ".jpeg")
#: Bytes of files that make a partition, about.
PART = 32_000_000
FIELDS = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("components", pa.int32()), ("values", pa.binary()), ("error", pa.struct([(c, pa.string()) for c in ("stage", "code", "details")]))])


def opened(path: str):
    """File system and path; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def read_any(data: bytes, bits: int) -> np.ndarray:
    if data[:2] == b"\xff\xd8":
        return codec.decode_raster(data, bits=bits)
    return files.load_raster(data, bits)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RasterReader(DataSourceReader):
    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits

    def partitions(self):
        system, root = opened(self.path)
        one = system.get_file_info(root)
        found = [one] if one.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(root, recursive=True))
        out, size = [[]], 0
        for f in sorted((f for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(KINDS)), key=lambda f: f.path):
            if out[-1] and size + f.size > PART:
                out.append([])
                size = 0
            out[-1].append(f.path)
            size += f.size
        return [Files(p) for p in out]

    def read(self, partition):
        system, _ = opened(self.path)
        for path in partition.paths if partition else ():
            with system.open_input_file(path) as source:
                data = source.read()
            try:
                row = (*codec.raster_row(read_any(data, self.bits), self.bits), None)
            except (ValueError, IndexError, KeyError, OverflowError, struct.error) as error:
                row = (None, None, None, None, faults.fault(error))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, *row), FIELDS, strict=True)], schema=FIELDS)


class Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RasterWriter(DataSourceArrowWriter):
    """A task that runs twice writes the same files again."""

    def __init__(self, path: str, kind: str, bits: int, quality: int):
        self.path, self.kind, self.bits, self.quality = path, kind, bits, quality

    def write(self, iterator):
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        paths = []
        for batch in iterator:
            columns = [batch.column(c) for c in ("image_id", "width", "height", "values")]
            for k in range(batch.num_rows):
                image_id, w, h, values = (c[k].as_py() for c in columns)
                raster = codec.raster_of(w, h, values, self.bits)
                data = codec.encode_raster(raster, self.quality) if self.kind == "jpg" else files.save_raster(raster, self.kind, self.bits)
                suffix = self.kind if self.kind != "pnm" else "pgm" if raster.shape[2] == 1 else "ppm"
                paths.append(f"{root}/{image_id}.{suffix}")
                with system.open_output_stream(paths[-1]) as out:
                    out.write(data)
        return Written(paths)

    def abort(self, messages):
        system, _ = opened(self.path)
        for m in messages:
            for path in m.paths if m is not None else ():
                system.delete_file(path)


class RasterDataSource(DataSource):
    @classmethod
    def name(cls):
        return "rasters"

    def schema(self):
        return f"path string, width int, height int, components int, values binary, {faults.ERROR}"

    def reader(self, schema):
        return RasterReader(self.options["path"], int(self.options.get("bits", "8")))

    def writer(self, schema, overwrite):
        kind = self.options.get("kind", "pnm")
        if kind not in ("pnm", "bmp", "jpg"):
            raise ValueError("files: unsupportedKind")
        return RasterWriter(self.options["path"], kind, int(self.options.get("bits", "8")), int(self.options.get("quality", "85")))


def register(spark) -> None:
    spark.dataSource.register(RasterDataSource)
