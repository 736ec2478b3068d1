"""Commands that packages bring: Python callables under the names their manifests give. No process is started."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: A command takes its settings (CALL_DIR, MANIFEST_DIR) and arguments and returns an exit code; none is 0.
Command = Callable[[dict[str, str], list[str]], int | None]


class Plugins:
    """``declared`` (pkg, name, path) are the plugins of all manifests of one project; a name of two packages is an
    error. ``commands`` has the callable for each path."""

    def __init__(self, declared: DataFrame, commands: dict[str, Command], *, root: str):
        self.root, self.commands, self.paths = root, commands, {}
        owners: dict[str, str] = {}
        for r in declared.select("name", "pkg", "path").distinct().orderBy("name", "pkg").collect():  # a few a project
            if owners.setdefault(r.name, r.pkg) != r.pkg:
                raise ValueError(f"plugin {r.name} is declared by {owners[r.name]} and {r.pkg}")
            self.paths[r.name] = r.path

    def run(self, name: str, args: list[str], *, call_dir: str) -> int:
        """The exit code of a plugin; an unknown name, and a path without a callable, is an error."""
        if name not in self.paths:
            raise KeyError(f"unknown command {name}")
        if self.paths[name] not in self.commands:
            raise KeyError(f"nothing is registered for {self.paths[name]}")
        return self.commands[self.paths[name]]({"CALL_DIR": call_dir, "MANIFEST_DIR": self.root}, list(args)) or 0
