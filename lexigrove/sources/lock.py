"""A single-writer lock: a directory, or, on a shared file system, a file that only one process can make.

Inside stand the owner's process id, host and start.  A lock is taken over only if its owner ran on this
host and is dead; what another host holds, or a process that can't be told, is waited for.
"""

import os
import shutil
import socket
import time

from .files import Files


class LockTimeout(TimeoutError):
    """The lock stayed in other hands."""


def _started(pid: int) -> str:
    """When a process of this host began, so that a pid that is used again isn't taken for its owner; empty where that isn't told."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            return f.read().rpartition(")")[2].split()[19]
    except (OSError, IndexError):
        return ""


class Lock:
    """``with Lock(path, timeout):`` waits up to ``timeout`` seconds; a dead process's lock is taken over."""

    def __init__(self, path: str, timeout: float = 5.0, pause: float = 0.05, files: Files | None = None):
        self.path, self.timeout, self.pause, self.files, self.held = path, timeout, pause, files, False

    def _owner(self) -> str:
        if self.files:
            return self.files.read(self.path)
        with open(os.path.join(self.path, "pid")) as f:
            return f.read()

    def _stale(self) -> bool:
        try:
            pid, host, started, *_ = [*self._owner().split("\n"), "", ""]
            pid = int(pid)
        except Exception:  # being written or removed at this moment
            return False
        if host and host != socket.gethostname():
            return False
        try:
            os.kill(pid, 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return bool(started) and _started(pid) != started

    def _make(self) -> bool:
        mine = f"{os.getpid()}\n{socket.gethostname()}\n{_started(os.getpid())}"
        if self.files:
            if self.files.exists(self.path):
                return False
            try:
                self.files.write(self.path, mine, True)
            except Exception:
                if self.files.exists(self.path):  # another was faster
                    return False
                raise
            return True
        try:
            os.mkdir(self.path)
        except FileExistsError:
            return False
        with open(os.path.join(self.path, "pid"), "w") as f:
            f.write(mine)
        return True

    def _remove(self) -> None:
        self.files.delete(self.path) if self.files else shutil.rmtree(self.path, ignore_errors=True)

    def acquire(self) -> None:
        end = time.monotonic() + self.timeout
        while not self._make():
            if self._stale():
                self._remove()
                continue
            if time.monotonic() >= end:
                raise LockTimeout(f"{self.path} is held by another writer")
            time.sleep(self.pause)
        self.held = True

    def release(self) -> None:
        if self.held:
            self.held = False
            self._remove()

    def __enter__(self):
        self.acquire()
        return self

    def __exit__(self, *_):
        self.release()
