"""A sink of sample directories with a two-phase commit: ``df.write.format("sample_directory").mode("append").save(root)``.

Tasks write whole samples below ``root/_staging/RUN``, each attempt in a folder of its own. When all tasks are done the driver moves each sample to its
place in one rename; when one fails the run's folder is removed and nothing has appeared. Mode ``append`` refuses samples that are there
already, before any is moved; ``overwrite`` replaces them, which makes a rerun safe, also one after a driver that died between two renames. Other samples stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Columns that become files; all others go to metadata.json.
FILES = ("sample_id", "url", "html", "screenshot", "label")
STAGING = "_staging"


def opened(root: str):
    """The file system of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if ":" in root.split("/", 1)[0] else f"file://{root}")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class SampleWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.run = root.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Staged:
        system, base = opened(self.root)
        folder, names = f"{base}/{STAGING}/{self.run}/{uuid.uuid4().hex}", []
        for r in rows:
            row = r.asDict()
            if not row["sample_id"]:
                raise ValueError("a sample without a name")
            short = row["sample_id"].split("_", 1)[0]
            meta = {k: v for k, v in row.items() if k not in FILES} | {"sample_id": row["sample_id"], "label": row["label"], "url": row["url"], "external_test_only": True}
            parts = {
                f"URL/{short}.txt": f"{row['url'] or ''}\n".encode(), f"RAW-HTML/{short}.html": (row["html"] or "").replace("\r\n", "\n").replace("\r", "\n").encode(), f"SCREEN-SHOT/{short}.png": bytes(row["screenshot"] or b""),
                f"Label/{short}.txt": f"{row['label']}\n".encode(), "metadata.json": json.dumps(meta, indent=2, ensure_ascii=False, default=str).encode(),
            }
            for name, data in parts.items():
                to = f"{folder}/{row['sample_id']}/{name}"
                system.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(to) as f:
                    f.write(data)
            names.append(row["sample_id"])
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.root)
        moves = {n: m.folder for m in messages if m for n in m.names}
        if len(moves) < sum(len(m.names) for m in messages if m):
            self.abort(messages)
            raise ValueError("two samples have the same name")

        def there(name: str) -> bool:
            return system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound

        def publish(name: str) -> None:
            if there(name):
                system.create_dir(f"{base}/{STAGING}/{self.run}/replaced", recursive=True)
                system.move(f"{base}/{name}", f"{base}/{STAGING}/{self.run}/replaced/{name}")
            system.move(f"{moves[name]}/{name}", f"{base}/{name}")

        with ThreadPoolExecutor(16) as pool:
            old = [n for n, x in zip(moves, pool.map(there, moves), strict=True) if x]
            if old and not self.overwrite:
                self.abort(messages)
                raise FileExistsError(f"samples are there already: {', '.join(sorted(old)[:5])}")
            list(pool.map(publish, moves))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        system, base = opened(self.root)
        if system.get_file_info(f"{base}/{STAGING}/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{STAGING}/{self.run}")


class SampleDirectory(DataSource):
    """SNK5: the sink of (sample_id, url, html, screenshot, label) and metadata columns."""

    @classmethod
    def name(cls) -> str:
        return "sample_directory"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if missing := sorted(set(FILES) - set(schema.names)):
            raise ValueError(f"missing columns: {', '.join(missing)}")
        return SampleWriter(self.options["path"], overwrite)
