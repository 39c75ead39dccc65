"""Calls in a child process, so that code that hangs or dies costs one call and not the task."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Sequence
from multiprocessing.connection import Connection


class Failed(Exception):
    """The call raised, hung or took its process down; the message says which."""


def _serve(functions: Sequence[Callable], mine: Connection, theirs: Connection) -> None:
    theirs.close()  # so that the end of the parent is seen here
    while True:
        try:
            place, argument = mine.recv()
        except EOFError:
            return
        try:
            mine.send((True, functions[place](argument)))
        except Exception as error:
            mine.send((False, str(error) or type(error).__name__))


class Isolated:
    """Calls one of `functions` in a child, which is forked at the first call and again after
    one was lost. Arguments and results are pickled; the functions need not be."""

    def __init__(self, functions: Sequence[Callable], seconds: float) -> None:
        self.functions, self.seconds = functions, seconds
        self.child: multiprocessing.Process | None = None
        self.pipe: Connection | None = None

    def _start(self) -> None:
        fork = multiprocessing.get_context("fork")
        self.pipe, mine = fork.Pipe()
        self.child = fork.Process(target=_serve, args=(self.functions, mine, self.pipe), daemon=True)
        self.child.start()
        mine.close()

    def call(self, place: int, argument):
        if self.child is None:
            self._start()
        try:
            self.pipe.send((place, argument))
            if not self.pipe.poll(self.seconds):
                self.close()
                raise Failed(f"no result after {self.seconds:g} seconds")
            fine, result = self.pipe.recv()
        except (EOFError, OSError) as error:
            child = self.child
            child.join(5)
            self.close()
            raise Failed(f"the process ended with code {child.exitcode}") from error
        if not fine:
            raise Failed(result)
        return result

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join(5)
            self.pipe.close()
            self.child = None
