"""Snapshot resolution: from a dataset's folders to the data files of one state of it.

A dated folder may hold alternative partitionings (``by_<column>``, of which one is
read), and each partition may hold frames (``as_at_<time>``): the newest frame with
``frame.complete`` and without ``frame.ignore`` counts.  Where a write left a manifest, the files
that it names count; else only names are looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

from .paths import bare, sanitize

CONTROL = (".ignore", ".complete", ".manifest", ".idx")
_ASIDE = re.compile(r"/(BACKOUT|_temporary|_staging-[^/]*)/")  # dead letters, and what is being written
_BY = re.compile(r"/by_([^/]+)/")
_FRAME = re.compile(r"^(.*)/(as_at_[^/]+)/(.*)$")


def is_data(path: str) -> bool:
    name = path.rsplit("/", 1)[-1]
    return not name.startswith(("_", ".")) and not name.endswith(CONTROL) and not _ASIDE.search(path)


def choose_partitioning(files: list[str], partition: tuple[str, str, str] | None = None) -> list[str]:
    """Of every folder that holds ``by_*`` folders the files of one of them: that of the
    partition filter's field if it exists there, else the last by name.  Files of folders
    without any pass."""
    if partition and partition[1] not in ("=", "=="):
        raise NotImplementedError("partition filters know '=' alone")
    fields: dict[str, set[str]] = defaultdict(set)
    for f in files:
        if m := _BY.search(f):
            fields[f[: m.start()]].add(m[1])
    chosen = {}
    for folder, names in fields.items():
        chosen[folder] = f"{folder}/by_{max(names)}/"
        if partition and sanitize(partition[0]) in names:
            name = sanitize(partition[0])
            chosen[folder] = f"{folder}/by_{name}/{name}={sanitize(partition[2])}/"

    def passes(f: str) -> bool:
        folder = f
        while "/" in folder:  # the nearest folder above that has partitionings
            folder = folder.rsplit("/", 1)[0]
            if folder in chosen:
                return f.startswith(chosen[folder])
        return True

    return [f for f in files if passes(f)]


def newest_frames(files: list[str]) -> list[str]:
    """Per folder the files of its newest complete frame; files outside frames pass."""
    frames: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
    out = []
    for f in files:
        if m := _FRAME.match(f):
            frames[m[1]][m[2]].append(f)
        else:
            out.append(f)
    for folder in frames.values():
        ready = [k for k, v in folder.items() if any(x.endswith("/frame.complete") for x in v) and not any(x.endswith("/frame.ignore") for x in v)]
        if ready:
            out += folder[max(ready)]
    return sorted(out)


def committed(files: list[str], listed: Callable[[list[str]], dict[str, list[str]]]) -> list[str]:
    """Of the files below a folder with manifests those that its newest whole one names; in place of
    an ignored frame's those of the next older one.  Control files pass.  ``listed`` gives the
    names in each whole manifest.  A manifest above its frames makes them complete."""
    by_folder: dict[str, list[str]] = defaultdict(list)
    for f in files:
        if f.endswith(".manifest"):
            by_folder[f.rsplit("/", 1)[0]].append(f)
    if not by_folder:
        return files
    names = listed([m for ms in by_folder.values() for m in ms])
    ignored = {f.rsplit("/", 1)[0] for f in files if f.endswith("/frame.ignore")}
    wanted: set[str] = set()
    markers: set[str] = set()
    for folder, manifests in by_folder.items():
        open_: set[str] | None = None  # folders whose newest frame is ignored; at first all are open
        for m in sorted(manifests, reverse=True):
            if bare(m) not in names or open_ == set():
                continue
            passed: set[str] = set()
            for f in (f"{folder}/{n}" for n in names[bare(m)]):
                x = _FRAME.match(f)
                above, frame = (x[1], f"{x[1]}/{x[2]}") if x else (folder, folder)
                if frame in ignored:
                    passed.add(above)
                elif open_ is None or above in open_:
                    wanted.add(f)
                    markers |= {f"{frame}/frame.complete"} if frame != folder else set()
            open_ = passed if open_ is None else open_ & passed

    def passes(f: str) -> bool:
        folder = f
        while "/" in folder:
            folder = folder.rsplit("/", 1)[0]
            if folder in by_folder:
                return f in wanted
        return True

    return sorted({f for f in files if not is_data(f) or passes(f)} | markers)


def resolve(files: list[str], partition: tuple[str, str, str] | None = None, listed: Callable[[list[str]], dict[str, list[str]]] | None = None) -> list[str]:
    files = [f for f in files if not _ASIDE.search(f)]
    files = committed(files, listed) if listed else files
    return [f for f in newest_frames(choose_partitioning(files, partition)) if is_data(f)]
