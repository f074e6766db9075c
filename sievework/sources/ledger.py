"""Carrying out a clean-up on the driver: files are renamed into a review folder and back, one by one, with a manifest that is written before each move."""

from __future__ import annotations

import errno
import json
import os
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from sievework.schema import REVIEW_FOLDER

MANIFEST = "manifest.json"
VERSION = 1
SUFFIXES = (".json", ".supplemental-metadata.json")
TRIES = 10_000


@dataclass
class Manifest:
    path: str
    id: str
    created: str
    entries: list[dict] = field(default_factory=list)

    @property
    def folder(self) -> str:
        return os.path.dirname(self.path)

    @property
    def root(self) -> str:
        return os.path.dirname(os.path.dirname(self.folder))

    def save(self) -> None:
        """Whole or not at all."""
        os.makedirs(self.folder, exist_ok=True)
        with open(self.path + ".tmp", "w", encoding="utf-8") as f:
            json.dump({"Version": VERSION, "Id": self.id, "CreatedUtc": self.created, "Files": self.entries}, f, ensure_ascii=False, indent=1)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.path + ".tmp", self.path)

    @staticmethod
    def load(path: str) -> Manifest | None:
        """None for a manifest that is missing, broken or of another version."""
        try:
            with open(path, encoding="utf-8") as f:
                m = json.load(f)
            return Manifest(path, m["Id"], m["CreatedUtc"], list(m["Files"])) if m["Version"] == VERSION else None
        except (OSError, ValueError, KeyError, TypeError):
            return None


def move(src: str, dst: str) -> None:
    """Rename within one file system; never copies, never overwrites."""
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    os.link(src, dst)  # fails where dst exists, or is on another device
    os.unlink(src)


def failure_of(e: OSError) -> str:
    return "InUse" if e.errno in (errno.EBUSY, errno.ETXTBSY, errno.EACCES) else "NotFound" if e.errno == errno.ENOENT else "IoError"


def unused_name(path: str) -> str:
    """path, or path with (2), (3) .. before its ending, whichever isn't there yet."""
    if not os.path.lexists(path):
        return path
    stem, end = os.path.splitext(path)
    for n in range(2, TRIES):
        if not os.path.lexists(other := f"{stem} ({n}){end}"):
            return other
    raise OSError(errno.EEXIST, "no unused name", path)


def is_unchanged(row: dict) -> bool:
    try:
        s = os.stat(row["path"])
    except OSError:
        return False
    return s.st_size == row["size_bytes"] and datetime.fromtimestamp(s.st_mtime, timezone.utc).replace(tzinfo=None) == row["last_write"]


@dataclass
class Outcome:
    moved: list[tuple[str, str]] = field(default_factory=list)
    failures: list[tuple[str, str]] = field(default_factory=list)
    sidecars: int = 0
    sidecar_failures: list[tuple[str, str]] = field(default_factory=list)
    manifests: list[str] = field(default_factory=list)


def execute(plan: list[dict], now: datetime | None = None, review: str = REVIEW_FOLDER) -> Outcome:
    """plan: rows of cleanup.plan() (group_id, path, action, root, relative_path, size_bytes, last_write). A group of which no kept copy is unchanged is left alone; a file that has changed is left alone; sidecars follow their photo."""
    now = now or datetime.now()
    out, manifests, batch = Outcome(), {}, str(uuid.uuid4())
    roots = sorted({r["root"] for r in plan if r["action"] == "remove"})
    stamp, n = now.strftime("%Y-%m-%d %H.%M.%S"), 1
    while any(os.path.lexists(os.path.join(r, review, stamp if n == 1 else f"{stamp} ({n})")) for r in roots):
        n += 1
    stamp = stamp if n == 1 else f"{stamp} ({n})"
    by_group: dict[str, list[dict]] = {}
    for r in plan:
        by_group.setdefault(r["group_id"], []).append(r)
    for rows in by_group.values():
        remove = [r for r in rows if r["action"] == "remove"]
        if not any(is_unchanged(r) for r in rows if r["action"] == "keep"):
            out.failures += [(r["path"], "KeptCopyMissing") for r in remove]
            continue
        for r in remove:
            m = manifests.setdefault(r["root"], Manifest(os.path.join(r["root"], review, stamp, MANIFEST), batch, now.isoformat()))
            if not os.path.lexists(r["path"]):
                out.failures.append((r["path"], "NotFound"))
            elif not is_unchanged(r):
                out.failures.append((r["path"], "ChangedSinceScan"))
            elif (why := _move_in(m, r["path"], r["relative_path"], None)) is not None:
                out.failures.append((r["path"], why))
            else:
                photo = m.entries[-1]["RelativePath"]
                out.moved.append((r["path"], os.path.join(m.folder, photo)))
                for s in SUFFIXES:
                    if os.path.isfile(r["path"] + s):
                        why = _move_in(m, r["path"] + s, photo + s, photo)
                        if why is None:
                            out.sidecars += 1
                        else:
                            out.sidecar_failures.append((r["path"] + s, why))
    for m in manifests.values():
        if m.entries:
            out.manifests.append(m.path)
        else:
            remove_if_empty(m)
    return out


def _move_in(m: Manifest, path: str, relative: str, photo: str | None) -> str | None:
    """Written down, then moved; the entry is taken back where the move fails."""
    try:
        s = os.stat(path)
        target = unused_name(os.path.join(m.folder, relative))
        m.entries.append({"RelativePath": os.path.relpath(target, m.folder), "Original": path, "SizeBytes": s.st_size, "LastWriteUtc": s.st_mtime, "SidecarOf": photo})
        m.save()
    except OSError as e:
        return failure_of(e)
    try:
        move(path, target)
        return None
    except OSError as e:
        m.entries.pop()
        m.save()
        return failure_of(e)


def batches(roots: list[str], review: str = REVIEW_FOLDER) -> list[Manifest]:
    """The manifests below the roots' review folders, newest first."""
    found = []
    for root in dict.fromkeys(map(os.path.abspath, roots)):
        base = os.path.join(root, review)
        for name in sorted(os.listdir(base)) if os.path.isdir(base) else []:
            if (m := Manifest.load(os.path.join(base, name, MANIFEST))) is not None:
                found.append(m)
    return sorted(found, key=lambda m: m.created, reverse=True)


def undo(manifest: str) -> Outcome:
    """Move a batch's files back, never over another: what has its place taken gets a numbered name. Each one back is struck from the manifest at once, so an undo that broke off is run again. Sidecars go where their photo went; one whose photo can't be put back waits in the manifest."""
    out = Outcome()
    m = Manifest.load(manifest)
    if m is None:
        return out
    landed: dict[str, str] = {}
    for e in [e for e in m.entries if e["SidecarOf"] is None]:
        src = os.path.join(m.folder, e["RelativePath"])
        if not os.path.lexists(src):
            if os.path.lexists(e["Original"]) and os.path.getsize(e["Original"]) == e["SizeBytes"]:
                landed[e["RelativePath"]] = e["Original"]  # an earlier try got this far
                m.entries.remove(e)
                m.save()
            else:
                out.failures.append((e["Original"], "NotFound"))
            continue
        try:
            target = unused_name(e["Original"])
            move(src, target)
        except OSError as x:
            out.failures.append((e["Original"], failure_of(x)))
            continue
        landed[e["RelativePath"]] = target
        out.moved.append((e["Original"], target))
        m.entries.remove(e)
        m.save()
    for e in [e for e in m.entries if e["SidecarOf"] is not None]:
        if e["SidecarOf"] not in landed:
            continue
        suffix = e["RelativePath"][len(e["SidecarOf"]) :]
        try:
            move(os.path.join(m.folder, e["RelativePath"]), unused_name(landed[e["SidecarOf"]] + suffix))
        except OSError as x:
            out.sidecar_failures.append((e["Original"], failure_of(x)))
            continue
        out.sidecars += 1
        m.entries.remove(e)
        m.save()
    if not m.entries:
        remove_if_empty(m)
    return out


def remove_if_empty(m: Manifest) -> None:
    """The batch's folders, deepest first, as far as nothing is in them."""
    if os.path.exists(m.path):
        os.unlink(m.path)
    folders = sorted((d for d, _, _ in os.walk(m.folder)), key=len, reverse=True)
    for d in [*folders, os.path.dirname(m.folder)]:
        try:
            os.rmdir(d)
        except OSError:
            pass
