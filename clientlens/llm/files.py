"""Files in shared folders, opened from tasks by URI."""

from __future__ import annotations

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: bytes) -> None:
    """Write beside, then move: readers and retried tasks see whole files only."""
    system, path = open_fs(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(URI, size) of the files in a folder; none if the folder is absent."""
    system, path = open_fs(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((f"{uri}/{i.base_name}", i.size) for i in found if i.base_name.endswith(suffix))
