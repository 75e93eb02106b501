"""What the tasks of one barrier stage tell each other, by files of a folder they share.

Spark's own ``allGather`` answers after a second (it sleeps that long before it looks),
and a job of its own for every message costs 0.1 to 0.2 s. The folder lies in the shared
checkpoint storage. A file appears by a rename, holds a part for each task, and goes
when its writer knows that all have read it.
"""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyarrow import fs
from pyspark import BarrierTaskContext


def shared(folder: str) -> bool:
    """Whether Python can reach the folder (a URI) that Spark has made."""
    try:
        store, path = fs.FileSystem.from_uri(folder)
        return store.get_file_info(path).type == fs.FileType.Directory
    except (OSError, ValueError):
        return False


class Peers:
    """The tasks of the running barrier stage. All of them call ``deal`` equally often."""

    def __init__(self, folder: str):
        task = BarrierTaskContext.get()
        self.me, self.n = task.partitionId(), len(task.getTaskInfos())
        self.store, path = fs.FileSystem.from_uri(folder)
        # a stage that is tried again must not read what its former attempt wrote: each has a folder of its own
        self.path = f"{path}/{task.allGather(uuid.uuid4().hex)[0]}"
        self.store.create_dir(self.path)
        self.calls = 0

    def _file(self, call: int, task: int) -> str:
        return f"{self.path}/{call:09d}-{task:04d}"

    def _part_of(self, task: int) -> bytes:
        wait = 0.0002
        while True:
            try:
                with self.store.open_input_file(self._file(self.calls, task)) as f:
                    ends = np.frombuffer(f.read_at(8 * self.n, 0), np.int64)
                    start = int(ends[self.me - 1]) if self.me else 0
                    return f.read_at(int(ends[self.me]) - start, 8 * self.n + start)
            except FileNotFoundError:
                time.sleep(wait)
                wait = min(2 * wait, 0.0008)

    def deal(self, parts: list[bytes]) -> list[bytes]:
        """Sends ``parts[j]`` to task j; returns what each task had for this one."""
        draft = f"{self.path}/draft-{self.me:04d}"
        with self.store.open_output_stream(draft) as f:
            f.write(np.cumsum([len(p) for p in parts]).astype(np.int64).tobytes())
            for p in parts:
                f.write(p)
        self.store.move(draft, self._file(self.calls, self.me))
        got = [parts[j] if j == self.me else self._part_of(j) for j in range(self.n)]
        if self.calls:  # who has written this call's file has read all files of the last
            self.store.delete_file(self._file(self.calls - 1, self.me))
        self.calls += 1
        return got

    def tell(self, part: bytes) -> list[bytes]:
        """Sends the same to all tasks; returns what each task said."""
        return self.deal([part] * self.n)
