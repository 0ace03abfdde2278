"""Answers that tasks have already got from a model, kept where a task that runs again finds them."""

from __future__ import annotations

import json
import uuid

import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system of a folder and the path within it; null where this process can't open it."""
    try:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    except (OSError, ValueError, ImportError):
        return None


class AnswerLog:
    """Records by bucket and key in files of JSON lines under a folder that all tasks share.

    A file is written under another name and renamed, so readers see whole files. Several attempts of a task write files of
    their own; of records with the same key one counts.
    """

    def __init__(self, path: str):
        self.fs, self.root = filesystem(path) or (None, path)
        self.known: dict[int, dict[str, dict]] = {}

    def get(self, bucket: int, key: str) -> dict | None:
        if self.fs is None:
            return None
        if bucket not in self.known:
            self.known[bucket] = {}
            chosen = pafs.FileSelector(f"{self.root}/{bucket}", allow_not_found=True)
            for info in self.fs.get_file_info(chosen):
                if info.base_name.endswith(".jsonl"):
                    with self.fs.open_input_stream(info.path) as f:
                        for line in f.read().decode().splitlines():
                            record = json.loads(line)
                            self.known[bucket][record["key"]] = record
        return self.known[bucket].get(key)

    def add(self, bucket: int, records: list[dict]) -> None:
        if self.fs is None or not records:
            return
        name = f"{self.root}/{bucket}/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.root}/{bucket}", recursive=True)
        with self.fs.open_output_stream(f"{name}.tmp") as f:
            f.write("".join(json.dumps(r) + "\n" for r in records).encode())
        self.fs.move(f"{name}.tmp", f"{name}.jsonl")
        self.known.setdefault(bucket, {}).update({r["key"]: r for r in records})
