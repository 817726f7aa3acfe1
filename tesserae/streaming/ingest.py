"""Streams of images: whole files from a folder, and uploads that come in chunks."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tesserae.sources import segments as seg

#: What Spark's source of whole files gives.
FILES = "path string, modificationTime timestamp, length long, content binary"


def read_folder(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """image_id (a hash of the path), path, content of every file, those that arrive later included."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def whole(chunks: dict[int, bytes]) -> bytes | None:
    """The stream, if its chunks from 0 on hold all of it up to the end marker."""
    if sorted(chunks) != list(range(len(chunks))):
        return None
    data = b"".join(chunks[k] for k in range(len(chunks)))
    if b"\xff\xd9" not in data:
        return None
    try:
        end = max(offset for offset, *_ in seg.segments(data)) + 2
    except ValueError as error:
        if str(error).startswith("lexing: truncated"):
            return None
        raise
    return data[:end]


def assemble(chunks: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """image_id, content: one row per upload of chunks (image_id, chunk_seq from 0, bytes), made when its end marker is there.

    The state is an image's own chunks, in any order; a repeated chunk_seq counts once. It is dropped once the image
    is made, so a chunk that comes again after that starts a new upload. With patience_ms it is also dropped when an
    upload gets no chunk for so long a processing time: a service should set it, else uploads that never end are kept;
    a query that ends by itself (availableNow) waits for it. Chunks are joined only once an end marker may be among
    them. Null bytes count as empty.
    """

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        places, parts, ended = state.get if state.exists else ([], [], False)
        held = dict(zip(places, parts, strict=True))
        for frame in frames:
            for k, part in zip(frame["chunk_seq"], frame["bytes"], strict=True):
                part = bytes(part) if part is not None else b""
                ended = ended or b"\xff\xd9" in part or part.startswith(b"\xd9")
                held.setdefault(int(k), part)
        if ended and (data := whole(held)) is not None:
            state.remove()
            yield pd.DataFrame({"image_id": [key[0]], "content": [data]})
        else:
            state.update((list(held), list(held.values()), ended))
            if patience_ms:
                state.setTimeoutDuration(patience_ms)

    return chunks.groupBy("image_id").applyInPandasWithState(step, "image_id long, content binary", "places array<int>, parts array<binary>, ended boolean", "append", GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout)
