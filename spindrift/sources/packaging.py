"""Publishing result files: checksums, backup of what they replace, and a ZIP. Driver-side."""

from __future__ import annotations

import hashlib
import shutil
import time
import zipfile
from pathlib import Path


def sha256_of(path: Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def publish(staged: list[Path], folder: Path) -> list[Path]:
    """Move staged files into ``folder``; files that they replace are kept beside it."""
    folder.mkdir(parents=True, exist_ok=True)
    backup = folder.parent / f"{folder.name}-backup-{time.strftime('%Y%m%dT%H%M%S')}"
    out = []
    for path in staged:
        target = folder / path.name
        if target.exists():
            backup.mkdir(exist_ok=True)
            shutil.move(target, backup / path.name)
        out.append(Path(shutil.move(path, target)))
    return out


def package(files: list[Path], target: Path) -> dict[str, str]:
    """Deflate ``files`` into one ZIP and return their checksums; an existing ZIP is never replaced."""
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        for path in files:
            z.write(path, path.name)
    with zipfile.ZipFile(target) as z:
        if z.testzip():
            raise OSError(f"{target} is damaged")
    return {path.name: sha256_of(path) for path in files}
