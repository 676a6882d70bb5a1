"""What an editor or a repository hands over: files named by a hook, files for its set-up, and its rule for branches."""

from __future__ import annotations

import json
import subprocess
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a hook's JSON names the file that was edited, and the endings of what is looked at.
PATH_KEYS = ["path", "file_path", "filePath", "TargetFile", "file", "target_file"]
ENDINGS = (".md", ".markdown")


def _usable(names: list[str], folder: str) -> list[str]:
    """Markdown files that are there, each once, in order."""
    plain = [n.strip().strip("\"'") for n in names]
    return list(dict.fromkeys(n for n in plain if n.endswith(ENDINGS) and (Path(folder) / n).is_file()))


def handed(raw: str, folder: str = ".") -> list[str]:
    """Files that a hook's input names: the edited file of a JSON object, else one path a line."""
    try:
        data = json.loads(raw)
    except ValueError:
        data = None
    if isinstance(data, dict):
        inner = data.get("tool_input")
        for part in (inner if isinstance(inner, dict) else {}, data):
            if found := _usable([part[k] for k in PATH_KEYS if isinstance(part.get(k), str)], folder):
                return found[:1]
    return _usable(raw.splitlines(), folder)


def touched(folder: str = ".") -> list[str]:
    """Markdown files that differ from the last commit, and untracked ones."""
    run = lambda *args: subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True).stdout.split("\0")
    return _usable([*run("diff", "--name-only", "--relative", "-z", "HEAD"), *run("ls-files", "--others", "--exclude-standard", "-z")], folder)


def files(arguments: list[str], raw: str, folder: str = ".") -> list[str]:
    """Files that are named, else those that the input names, else those that git says have changed."""
    return list(arguments) or handed(raw, folder) or touched(folder)


_PRE_COMMIT = """  - repo: local
    hooks:
      - id: plumbline
        name: plumbline
        entry: python -m plumbline eval --preset safety
        language: system
        types: [markdown]
"""
_WORKFLOW = """name: plumbline
on: [pull_request]
jobs:
  evaluate:
    runs-on: ubuntu-latest
    steps:
      - uses: actions/checkout@v4
      - run: |
          python -m plumbline eval --since "origin/$GITHUB_BASE_REF" --format annotations && exit 0
          code=$?
          if [ "$code" -eq 3 ]; then echo "::notice::not everything could be evaluated"; exit 0; fi
          exit "$code"
"""


def scaffold(folder: str = ".", pre_commit: bool = True, workflow: bool = False) -> list[str]:
    """Write the set-up of a pre-commit hook and of a CI job; what is there already stays. Returns the files that were written."""
    written = []
    hook, job = Path(folder) / ".pre-commit-config.yaml", Path(folder) / ".github" / "workflows" / "plumbline.yml"
    if pre_commit:
        before = hook.read_text(encoding="utf-8") if hook.exists() else ""
        if "id: plumbline" not in before:
            head, mark, rest = before.partition("repos:\n")
            hook.write_text(f"{head}repos:\n{_PRE_COMMIT}{rest}" if mark else f"{before}repos:\n{_PRE_COMMIT}", encoding="utf-8")
            written.append(str(hook))
    if workflow and not job.exists():
        job.parent.mkdir(parents=True, exist_ok=True)
        job.write_text(_WORKFLOW, encoding="utf-8")
        written.append(str(job))
    return written


def branch_allowed(base: Column, head: Column) -> Column:
    """Whether a branch may be merged: only release branches into main, and main into no release branch."""
    plain = lambda c: F.replace(F.trim(c), F.lit("refs/heads/"), F.lit(""))
    release = plain(head).rlike(r"^(release/|release-please--)")
    return F.when(plain(base) == "main", release).when(plain(base).startswith("release/"), plain(head) != "main").otherwise(F.lit(True))
