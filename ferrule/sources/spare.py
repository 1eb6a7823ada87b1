"""Files written over others that nobody needs any more.

Making and removing a small file costs a file system several times what writing
over one does: it passes by places that files have left lately, and gives back
their blocks one by one.  Who writes millions of files for a while, a portion at
a time, keeps those of the portion before in folders that a task claims whole.
"""

from __future__ import annotations

import os
import uuid


class Folder:
    """A new folder of a task attempt's own: one of those in `spare`, with files to write over, if there is one left.

    Files that have another name somewhere are not written over: what they hold
    is still in use.
    """

    def __init__(self, own: str, spare: str | None = None):
        os.makedirs(os.path.dirname(own), exist_ok=True)
        self.own, self.left, self.done = own, [], set()
        for name in os.listdir(spare) if spare and os.path.isdir(spare) else []:
            try:
                os.rename(os.path.join(spare, name), own)
            except OSError:  # another attempt has it
                continue
            self.left = os.listdir(own)
            return
        os.makedirs(own)

    def write(self, data: bytes, name: str | None = None) -> str:
        """The path of a file of that content, and of that name if it matters; a FileExistsError if it has been written before."""
        if name in self.done:
            raise FileExistsError(os.path.join(self.own, name))
        while self.left:
            old = self.left.pop()
            if old in self.done:
                continue  # written under its name since
            path = os.path.join(self.own, old)
            try:
                if not _written_over(path, data):
                    os.remove(path)
                    continue
            except FileNotFoundError:
                continue
            if name not in (None, old):
                os.rename(path, os.path.join(self.own, name))
            break
        else:
            old = uuid.uuid4().hex
            with open(os.path.join(self.own, name or old), "xb") as f:
                f.write(data)
        if name is not None:
            self.done.add(name)
        return os.path.join(self.own, name or old)

    def clear(self) -> None:
        """Removes what has not been written over."""
        for old in self.left:
            if old not in self.done and os.path.exists(path := os.path.join(self.own, old)):
                os.remove(path)
        self.left = []


def _written_over(path: str, data: bytes) -> bool:
    """Whether it could be, as the file has no other name."""
    fd = os.open(path, os.O_WRONLY)
    try:
        about = os.fstat(fd)
        if about.st_nlink > 1:
            return False
        if os.write(fd, data) < len(data):
            raise OSError(f"{path}: not written whole")
        if about.st_size > len(data):
            os.ftruncate(fd, len(data))
        return True
    finally:
        os.close(fd)


def give(own: str, spare: str) -> None:
    """An attempt's folder becomes one of those that later ones may claim."""
    os.makedirs(spare, exist_ok=True)
    os.rename(own, os.path.join(spare, uuid.uuid4().hex))
