"""Pinned snapshots of sources on the driver's file system: one ``current`` folder each, replaced as a whole."""

from __future__ import annotations

import contextlib
import hashlib
import json
import shutil
import tempfile
import urllib.error
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

MANIFEST = "snapshot.json"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def current(root: Path, source: str) -> Path:
    return Path(root) / source / "current"


@contextlib.contextmanager
def _replacing(target: Path) -> Iterator[Path]:
    """A folder to fill beside ``target``; takes its place at the end, or leaves it untouched on any error."""
    target.parent.mkdir(parents=True, exist_ok=True)
    work = Path(tempfile.mkdtemp(prefix=".incoming-", dir=target.parent))
    fresh, before = work / "new", work / "old"
    fresh.mkdir()
    try:
        yield fresh
        if target.exists():
            target.rename(before)
        try:
            fresh.rename(target)
        except BaseException:
            if before.exists():
                before.rename(target)
            raise
    finally:
        shutil.rmtree(work, ignore_errors=True)


def _manifest(folder: Path, source: str, origin: str, online: bool, digest: str, size: int, **more: object) -> None:
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    about = {"source": source, "origin": origin, "fetched_at": stamp, "fetched_online": online, "sha256": digest, "bytes": size} | more
    (folder / MANIFEST).write_text(json.dumps(about, indent=2) + "\n", encoding="utf-8")


def store_bytes(data: bytes, filename: str, source: str, root: Path, *, origin: str, online: bool = False, expected_sha256: str | None = None) -> Path:
    """Publishes one file as the current snapshot; a digest other than the expected one raises and changes nothing."""
    digest = sha256(data)
    if expected_sha256 not in (None, digest):
        raise ValueError(f"{source}: digest {digest}, expected {expected_sha256}")
    target = current(root, source)
    with _replacing(target) as fresh:
        (fresh / filename).write_bytes(data)
        _manifest(fresh, source, origin, online, digest, len(data), original_filename=filename)
    return target / filename


def store_file(path: Path, source: str, root: Path, *, origin: str) -> Path:
    return store_bytes(Path(path).read_bytes(), Path(path).name, source, root, origin=origin)


def store_url(url: str, source: str, root: Path, *, filename: str, timeout: float = 30.0, expected_sha256: str | None = None, opener=urllib.request.urlopen) -> Path:
    """Downloads a file and publishes it; the body of an HTTP error is part of the message."""
    try:
        with opener(url, timeout=timeout) as reply:
            data = reply.read()
    except urllib.error.HTTPError as error:
        raise RuntimeError(f"{source}: HTTP {error.code}: {error.read().decode(errors='replace')[:2000]}") from error
    return store_bytes(data, filename, source, root, origin=url, online=True, expected_sha256=expected_sha256)


def store_folder(folder: Path, source: str, root: Path, *, origin: str, online: bool = False) -> Path:
    """Publishes all files of a folder as one snapshot, with a digest of each and of the tree."""
    folder = Path(folder)
    if not folder.is_dir():
        raise NotADirectoryError(folder)
    names = sorted(p.relative_to(folder).as_posix() for p in folder.rglob("*") if p.is_file())
    if not names:
        raise ValueError(f"no files in {folder}")
    if MANIFEST in names:
        raise ValueError(f"{MANIFEST} is reserved")
    target = current(root, source)
    with _replacing(target) as fresh:
        tree, files = hashlib.sha256(), []
        for name in names:
            data = (folder / name).read_bytes()
            (fresh / name).parent.mkdir(parents=True, exist_ok=True)
            (fresh / name).write_bytes(data)
            files.append({"path": name, "sha256": sha256(data), "bytes": len(data)})
            tree.update(b"%b\0%b\0" % (name.encode(), data))
        _manifest(fresh, source, origin, online, tree.hexdigest(), sum(f["bytes"] for f in files), files=files)
    return target


def resolve(root: Path, source: str, pattern: str = "*.csv") -> Path:
    """The first file of the current snapshot that fits, by name."""
    found = sorted(current(root, source).glob(pattern))
    if not found:
        raise FileNotFoundError(f"no {pattern} in {current(root, source)}")
    return found[0]


def manifest(root: Path, source: str) -> dict:
    return json.loads((current(root, source) / MANIFEST).read_text(encoding="utf-8"))
