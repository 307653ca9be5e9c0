"""Changes that git reports, as relations. The commands run on the driver; their output is parsed here."""

from __future__ import annotations

import posixpath
import subprocess


def safe_path(path: str) -> str:
    """The cleaned project-relative path; ValueError if it leaves the project."""
    clean = posixpath.normpath(path.replace("\\", "/"))
    if not path or path.startswith("/") or clean in (".", "..") or clean.startswith("../"):
        raise ValueError(f"path escapes the project: {path!r}")
    return clean


def run_git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True, timeout=120).stdout


def changed_since(root: str, last: str | None) -> tuple[str, list[str]]:
    """HEAD, and paths that the working tree or commits since `last` have changed, old names of renames included.

    Raises OSError, SubprocessError or ValueError where git can't tell, also if the root isn't the top of a working tree.
    """
    if posixpath.realpath(run_git(root, "rev-parse", "--show-toplevel").strip()) != posixpath.realpath(root):
        raise ValueError("the project isn't the top of a working tree")
    head = run_git(root, "rev-parse", "HEAD").strip()
    changes = status_changes(run_git(root, "status", "--porcelain=v2", "--untracked-files=all", "-z"))
    if last and last != head:
        changes += diff_changes(run_git(root, "diff", "--name-status", "-z", last, head))
    return head, sorted({p for pair in changes for p in pair if p})


def tracked_paths(root: str) -> list[str]:
    """Tracked and untracked files that aren't ignored, first-seen, without unsafe paths."""
    out: dict[str, None] = {}
    for path in filter(None, run_git(root, "ls-files", "-co", "--exclude-standard", "-z").split("\0")):
        try:
            out[safe_path(path)] = None
        except ValueError:
            continue
    return list(out)


def status_changes(output: str) -> list[tuple[str, str | None]]:
    """(path, old path of a rename or None) of `git status --porcelain=v2 -z`; headers and ignored files are skipped."""
    out, fields = [], iter(output.split("\0"))
    for record in fields:
        kind = record[:1]
        if kind in ("", "#", "!"):
            continue
        blanks = {"?": 1, "1": 8, "2": 9, "u": 10}.get(kind)
        parts = record.split(" ", blanks) if blanks else []
        if not blanks or len(parts) != blanks + 1:
            raise ValueError(f"not a status record: {record!r}")
        old = next(fields, "") if kind == "2" else None
        if old == "":
            raise ValueError("a rename without its old path")
        out.append((safe_path(parts[-1]), old and safe_path(old)))
    return sorted(out, key=lambda x: x[0])


def diff_changes(output: str) -> list[tuple[str, str | None]]:
    """(path, old path) of `git diff --name-status -z`. Copies give both paths; only renames have an old path."""
    out, fields = [], iter(output.split("\0"))
    for kind in filter(None, fields):
        first = next(fields, "")
        second = next(fields, "") if kind[0] in "RC" else None
        if not first or second == "":
            raise ValueError("a diff record lacks a path")
        if second is None:
            out.append((safe_path(first), None))
        elif kind[0] == "R":
            out.append((safe_path(second), safe_path(first)))
        else:
            out += [(safe_path(first), None), (safe_path(second), None)]
    return sorted(out, key=lambda x: x[0])
