"""Files on whatever file system a path names, through pyarrow."""

from __future__ import annotations

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; a path without a scheme is local."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    if path.startswith("file:"):
        path = path[5:]
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder by name, hidden ones left out."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.is_file:
        return [(prefix + info.path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    base = inner.rstrip("/")
    keep = [f for f in found if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(base) :].strip("/").split("/"))]
    return sorted((prefix + f.path, f.size) for f in keep)


def open_file(path: str):
    """A seekable input."""
    system, inner = resolve(path)
    return system.open_input_file(inner)


def write_file(path: str, parts) -> None:
    system, inner = resolve(path)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as out:
        for p in parts:
            out.write(p)


def move(old: str, new: str) -> None:
    system, a = resolve(old)
    system.move(a, resolve(new)[1])


def remove(path: str) -> None:
    system, inner = resolve(path)
    kind = system.get_file_info(inner).type
    if kind == fs.FileType.Directory:
        system.delete_dir(inner)
    elif kind == fs.FileType.File:
        system.delete_file(inner)
