"""Published folders: files that are read safely, staged, locked and renamed into place once."""

from __future__ import annotations

import fcntl
import hashlib
import os
import stat
import tempfile
from contextlib import contextmanager
from pathlib import Path


def contained(root: Path, relative: str | Path) -> Path:
    """A path below ``root``; absolute paths, steps upward and links that lead outside are refused."""
    base, target = Path(root).resolve(), (Path(root) / relative).resolve()
    if Path(relative).is_absolute() or not target.is_relative_to(base):
        raise ValueError(f"{relative} leads out of {root}")
    return target


def open_regular(path: Path):
    """A regular file, open for reading; symbolic links and devices are refused."""
    try:
        fd = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError as e:
        raise ValueError(f"{path} is no regular file") from e
    f = os.fdopen(fd, "rb")
    if not stat.S_ISREG(os.fstat(fd).st_mode):
        f.close()
        raise ValueError(f"{path} is no regular file")
    return f


def read_regular(path: Path) -> bytes:
    """Bytes of a regular file."""
    with open_regular(path) as f:
        return f.read()


def read_folder(folder: Path, names: set[str]) -> dict[str, bytes]:
    """The files of a folder that holds exactly these names and is no link."""
    folder = Path(folder)
    if folder.is_symlink() or not folder.is_dir():
        raise ValueError(f"{folder} is no folder")
    if {p.name for p in folder.iterdir()} != names:
        raise ValueError(f"{folder} must hold exactly {sorted(names)}")
    return {n: read_regular(folder / n) for n in names}


@contextmanager
def lock(path: Path):
    """Only one process at a time; a process that dies lets go."""
    with open(path, "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


@contextmanager
def publishing(folder: Path):
    """A staging folder that becomes ``folder`` at the end, under a lock; nothing stays if the body fails or ``folder``
    exists by then. The body may set ``keep`` on the yielded path's holder to leave an existing folder as it is."""
    folder = Path(folder)
    folder.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=folder.parent, prefix=f".{folder.name}.staging-") as staging:
        stage = Path(staging) / folder.name
        stage.mkdir()
        with lock(folder.parent / f".{folder.name}.lock"):
            yield stage
            if folder.exists() or folder.is_symlink():
                raise FileExistsError(f"{folder} exists")
            stage.rename(folder)


def source_sha256(paths: list[Path]) -> str:
    """One hash of some source files by name and content: the identity of the code that made a data set."""
    digest = hashlib.sha256()
    for path in paths:
        digest.update(path.name.encode() + b"\0" + path.read_bytes() + b"\0")
    return digest.hexdigest()
