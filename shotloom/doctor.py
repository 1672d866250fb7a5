"""Checks of the environment, in order; the first failure ends with status 1."""

from __future__ import annotations

import os
import shutil
import tempfile


def checks(assets_dir: str | None = None) -> list[tuple[str, bool, str]]:
    """name, passed, detail."""
    import pyspark

    found = [("java", shutil.which("java") is not None or "JAVA_HOME" in os.environ, os.environ.get("JAVA_HOME", shutil.which("java") or "not found"))]
    found.append(("spark", int(pyspark.__version__.split(".")[0]) >= 4, pyspark.__version__))
    for tool in ("ffmpeg", "ffprobe"):
        found.append((tool, shutil.which(tool) is not None, shutil.which(tool) or "not found"))
    if assets_dir is not None:
        try:
            os.makedirs(assets_dir, exist_ok=True)
            with tempfile.TemporaryFile(dir=assets_dir):
                found.append(("assets", True, assets_dir))
        except OSError as e:
            found.append(("assets", False, str(e)))
    return found


def main(assets_dir: str | None = None) -> int:
    for name, passed, detail in checks(assets_dir):
        print(f"{'ok  ' if passed else 'FAIL'} {name}: {detail}")
        if not passed:
            return 1
    return 0
