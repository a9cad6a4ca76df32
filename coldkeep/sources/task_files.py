"""Files as tasks see them, through Arrow's file systems, for what Spark's readers do not tell."""

from __future__ import annotations

# Hadoop's names of stores that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def resolve(path: str):
    """(file system, path there) of a Hadoop URI."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def open_file(path: str):
    system, name = resolve(path)
    return system.open_input_file(name)


def listed(folder: str) -> list[tuple[str, int, object]]:
    """(name, length, time of change) of the plain files of a folder; none if it does not exist."""
    from pyarrow import fs

    system, name = resolve(folder)
    found = system.get_file_info(fs.FileSelector(name, allow_not_found=True))
    return sorted((f.base_name, f.size, f.mtime) for f in found if f.is_file)


def data_files(path: str) -> list[str]:
    """The files that Spark reads of a folder, in it and its name=value folders, or the one that the path itself names."""
    from pyarrow import fs

    system, name = resolve(path)
    if system.get_file_info(name).is_file:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    inside = [f.path.removeprefix(name.rstrip("/")).strip("/") for f in found if f.is_file and f.size]
    shown = [i for i in inside if all("=" in part for part in i.split("/")[:-1]) and not i.split("/")[-1].startswith((".", "_"))]
    return sorted(f"{path.rstrip('/')}/{i}" for i in shown)
