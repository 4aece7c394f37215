"""What a set of runs is of: its configuration, and the identity that a resumed run must keep."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import platform
import re
import shutil
import stat
import tarfile
import zipfile
from dataclasses import dataclass
from pathlib import Path


class IdentityChanged(RuntimeError):
    """A run would go on under other settings than it began with."""


@dataclass(frozen=True)
class Pair:
    """A program and a dataset, with tags such as `slow:skip`."""

    program: str
    dataset: str
    tags: frozenset[str] = frozenset()


def parse_pairs(text: str) -> list[Pair]:
    """Pairs of lines `program=dataset [tag] [tag]`; `#` begins a comment; lines without both are passed over."""
    out = []
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        tags = []
        while m := re.fullmatch(r"(.*\S)\s+\[([^\[\]]+)\]", line):
            line, tags = m[1], [*tags, m[2]]
        program, equals, dataset = (part.strip() for part in line.partition("="))
        if equals and program and dataset:
            out.append(Pair(program, dataset, frozenset(tags)))
    return out


def identity(config: str, **settings: object) -> dict[str, str]:
    """What must not change between a run and its resumption."""
    return {"config_sha256": hashlib.sha256(config.encode()).hexdigest(), **{k: str(v) for k, v in sorted(settings.items())}}


def guard(directory: str, now: dict[str, str], fresh: bool = False) -> None:
    """Writes the identity on a first run; on a later one raises where it differs, unless `fresh`."""
    path = Path(directory) / "run_info.json"
    if path.exists() and not fresh:
        before = json.loads(path.read_text())["identity"]
        if changed := sorted(k for k in before.keys() | now.keys() if before.get(k) != now.get(k)):
            raise IdentityChanged("; ".join(f"{k}: {before.get(k)} before, {now.get(k)} now" for k in changed))
        return
    path.parent.mkdir(parents=True, exist_ok=True)
    about = {"date": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "host": platform.node(), "os": platform.platform()}
    path.write_text(json.dumps({**about, "identity": now}, indent=1) + "\n")


def remove_dataset(directory: str) -> None:
    """Deletes a dataset's folder, but never through a link."""
    path = Path(directory)
    if path.is_symlink() or any(p.is_symlink() for p in path.parents):
        raise ValueError(f"{directory} is reached through a link: not deleted")
    if path.exists():
        shutil.rmtree(path)


def unpack(archive: str, directory: str) -> list[str]:
    """Unpacks a local .zip, .tar or .tar.zst archive into a new folder; the files' names.

    A name that leads out of the folder, or an entry that is no plain file or
    folder, is an error, and leaves nothing behind.
    """
    folder = Path(directory)
    if folder.exists():
        raise FileExistsError(directory)
    folder.mkdir(parents=True)
    try:
        if zipfile.is_zipfile(archive):
            with zipfile.ZipFile(archive) as z:
                for info in z.infolist():
                    if not _inside(folder, info.filename) or stat.S_ISLNK(info.external_attr >> 16):
                        raise ValueError(f"{archive}: {info.filename}")
                z.extractall(folder)
        else:
            with contextlib.ExitStack() as stack:
                file = stack.enter_context(open(archive, "rb"))
                if archive.endswith(".zst"):
                    import zstandard

                    file = stack.enter_context(zstandard.ZstdDecompressor().stream_reader(file))
                tar = stack.enter_context(tarfile.open(fileobj=file, mode="r|"))
                for info in tar:
                    if not (info.isfile() or info.isdir()) or not _inside(folder, info.name):
                        raise ValueError(f"{archive}: {info.name}")
                    tar.extract(info, folder, filter="data")
    except BaseException:
        shutil.rmtree(folder)
        raise
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def _inside(folder: Path, name: str) -> bool:
    return (folder / name).resolve().is_relative_to(folder.resolve())
