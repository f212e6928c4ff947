"""A call with a time limit, in a forked child that is killed when the time is over."""

from __future__ import annotations

import multiprocessing as mp
import os
import signal
from collections.abc import Callable


class TimedOut(Exception):
    """The call took longer than it may."""


def _child(pipe: object, f: Callable[..., object], args: tuple) -> None:
    os.setsid()  # what the call starts is killed with it
    try:
        pipe.send((True, f(*args)))  # type: ignore[attr-defined]
    except BaseException as e:  # noqa: BLE001
        pipe.send((False, e))  # type: ignore[attr-defined]


def guarded(f: Callable[..., object], seconds: float, *args: object) -> object:
    """f(*args), or TimedOut after so many seconds. An error of f is raised here."""
    fork = mp.get_context("fork")
    here, there = fork.Pipe(duplex=False)
    p = fork.Process(target=_child, args=(there, f, args), daemon=True)
    p.start()
    there.close()
    try:
        if not here.poll(seconds):
            raise TimedOut(f"more than {seconds} s")
        ok, value = here.recv()
    except EOFError:
        raise RuntimeError("the call's process died") from None
    finally:
        if p.is_alive():
            try:
                os.killpg(p.pid, signal.SIGKILL)
            except (ProcessLookupError, PermissionError):
                p.kill()
        p.join()
        here.close()
    if not ok:
        raise value
    return value
