"""Resumable work over a stream of images: each changed image once, whatever stops in between.

The state of an image is the signature that was worked on last. A row with another signature goes through the hook and
leaves one row; a row with the same one leaves nothing, be it a repeat in the stream or work that an earlier run recorded.
State and offsets live in the checkpoint and the file sink commits whole batches, so a stream that is stopped and started
again goes on where it was, and each result is written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "image string, seq long, signature string, status string, error string"
STATE = "signature string, status string"


def changed(images: DataFrame, work: Callable[[str, str], str]) -> DataFrame:
    """OUT of the rows of a stream (image, seq, signature, status) whose signature is not the last one of their image.

    work(image, signature) gives a status; what it raises becomes the status error. A row with a status says that this was done before:
    it sets the state and leaves no row. Rows of a batch count in the order of seq; null images are left out."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches]).sort_values("seq", kind="stable")  # one image's rows of one batch
        last = state.get if state.exists else (None, None)
        out = []
        for seq, signature, known in zip(rows["seq"], rows["signature"], rows["status"]):
            if known is not None:
                last = (signature, known)
                continue
            if last[1] is not None and signature == last[0]:
                continue
            error = None
            try:
                status = work(key[0], signature)
            except Exception as e:  # noqa: BLE001  (the row carries it)
                status, error = "error", f"{type(e).__name__}: {e}"
            last = (signature, status)
            out.append((key[0], int(seq), signature, status, error))
        if last != (None, None):
            state.update(last)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    rows = images.select("image", "seq", "signature", "status").where("image is not null")
    return rows.groupBy("image").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(images: DataFrame, work: Callable[[str, str], str], out: str, checkpoint: str) -> None:
    """Work through what is there and stop; a later call with the same checkpoint goes on behind it."""
    written = changed(images, work).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    written.start().awaitTermination()
