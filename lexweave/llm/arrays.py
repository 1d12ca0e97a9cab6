"""Sorted arrays in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
from pyarrow import fs


def write(uri: str, values: np.ndarray) -> str:
    """Write an array to a file of the shared folder under a new name, which is returned.

    A task that runs twice leaves two files of equal content; readers use the one it returned.
    """
    uri = f"{uri}-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(np.ascontiguousarray(values))
    return uri


def small(values: np.ndarray) -> np.ndarray:
    """Counts as a byte each; those from 255 on follow with their places."""
    big = np.flatnonzero(values >= 255)
    tail = np.concatenate([big, values[big]]).astype("<i8").tobytes()
    return np.concatenate([np.minimum(values, 255).astype(np.uint8), np.zeros(-len(values) % 8, np.uint8), np.frombuffer(tail, np.uint8)])


def small_at(data: np.ndarray, size: int, places: np.ndarray) -> np.ndarray:
    """The counts at places of what small() made of ``size`` counts."""
    out = data[places].astype(np.int64)
    at = np.flatnonzero(out == 255)
    if len(at):
        big, full = data[size + -size % 8 :].view("<i8").reshape(2, -1)
        out[at] = full[np.searchsorted(big, places[at])]
    return out


def write_sections(uri: str, parts: Sequence[np.ndarray]) -> tuple[str, list[int]]:
    """Write arrays to one file, each from a multiple of 8 on; its name, and where they begin and end."""
    data, cuts = [], []
    at = 0
    for x in parts:
        own = np.ascontiguousarray(x).view(np.uint8).ravel()
        cuts += [at, at + len(own)]
        data += [own, np.zeros(-len(own) % 8, np.uint8)]
        at += len(own) + -len(own) % 8
    return write(uri, np.concatenate(data)), cuts


def sections(uri: str, cuts: Sequence[int], kinds: Sequence[str]) -> list[np.ndarray]:
    """The arrays that write_sections() wrote."""
    data = read(uri, "u1")
    return [data[a:b].view(kind) for a, b, kind in zip(cuts[::2], cuts[1::2], kinds, strict=True)]


_open: dict[tuple[str, str], np.ndarray] = {}


def read(uri: str, kind: str) -> np.ndarray:
    """The array of a file, memory-mapped. What isn't mounted is fetched once per worker into a file without a name."""
    if (uri, kind) not in _open:
        system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
        if isinstance(system, fs.LocalFileSystem):
            values = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:
            with tempfile.TemporaryFile() as copy:
                with system.open_input_stream(path) as source:
                    while part := source.read(1 << 22):
                        copy.write(part)
                copy.flush()
                values = np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), kind) if copy.tell() else np.zeros(0, kind)
        _open[uri, kind] = values
    return _open[uri, kind]


class Sorted:
    """Sorted keys over several files, of which each follows the one before, with values beside them."""

    def __init__(self, parts: Sequence[tuple[int, int, str, Sequence[str]]], kinds: Sequence[str]):
        """parts: (first key, number of keys, file of the keys, files of the values)."""
        self.parts, self.kinds = sorted(parts), kinds
        self.firsts = np.array([p[0] for p in self.parts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum([p[1] for p in self.parts])]).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each sorted key's place among all keys, -1 where it is missing."""
        out = np.full(len(keys), -1, np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for (_, size, file, _), begin, a, b in zip(self.parts, self.begin, cuts[:-1], cuts[1:], strict=False):
            if size and a < b:
                own = read(file, "<i8")
                place = np.minimum(np.searchsorted(own, keys[a:b]), size - 1)
                out[a:b] = np.where(own[place] == keys[a:b], place + begin, -1)
        return out

    def by_part(self, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The numbers of the files that places (-1 for none) fall in, and which places do."""
        order = np.argsort(places, kind="stable")
        cuts = np.searchsorted(places[order], self.begin)
        for k in np.flatnonzero(np.diff(cuts)):
            yield int(k), order[cuts[k] : cuts[k + 1]]

    def values(self, places: np.ndarray, which: int, missing: float = 0) -> np.ndarray:
        """The values at sorted or unsorted places; ``missing`` for -1. Those of the kind "small" are what small() makes of counts."""
        kind = self.kinds[which]
        out = np.full(len(places), missing, np.int64 if kind == "small" else kind)
        for k, at in self.by_part(places):
            own, file = places[at] - self.begin[k], self.parts[k][3][which]
            out[at] = small_at(read(file, "u1"), self.parts[k][1], own) if kind == "small" else read(file, kind)[own]
        return out
