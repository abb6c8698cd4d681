"""Opening one file of a local or remote file system inside a task."""

from __future__ import annotations


def open_file(path: str):
    """Random-access handle; the path may be plain or a URI with one or three slashes."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)  # a plain path may hold blanks and percent signs
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def write_file(path: str, content: bytes) -> None:
    """Writes a whole file, with its folder, to the file system of the path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    filesystem, inner = (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)
    filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
    with filesystem.open_output_stream(inner) as out:
        out.write(content)


def list_folder(folder: str) -> list[tuple[str, int]]:
    """(path, size) of all files below a folder; paths are plain on a local system, else URIs."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if "://" not in folder:
        filesystem, inner, prefix = fs.LocalFileSystem(), folder, ""
    else:
        filesystem, inner = fs.FileSystem.from_uri(folder)
        prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else folder.split("://")[0] + "://"
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file)
