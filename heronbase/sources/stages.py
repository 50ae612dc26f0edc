"""Stages: named file areas of a schema, in the warehouse's store."""

from __future__ import annotations

from fnmatch import fnmatchcase

from heronbase.errors import AlreadyExists, InvalidValue, NotFound
from heronbase.sources.catalog import Catalog, Key, Named, upper


class Stages:
    def __init__(self, catalog: Catalog):
        self.catalog, self.store = catalog, catalog.store

    @staticmethod
    def _key(database: str, schema: str, name: str) -> Key:
        return upper(database), upper(schema), upper(name)

    def create(self, database: str, schema: str, name: str, kind: str = "INTERNAL", url: str = "", comment: str = "", if_not_exists: bool = False) -> Named:
        with self.catalog.lock:
            self.catalog.schema(database, schema)
            key = self._key(database, schema, name)
            if key in self.catalog.stages:
                if if_not_exists:
                    return self.catalog.stages[key]
                raise AlreadyExists(f"stage {'.'.join(key)} already exists")
            stage = Catalog._named(key[2], ".".join(key[:2]), comment, stage_type=kind.upper(), url=url)
            if kind.upper() == "INTERNAL":
                self.store.mkdirs("stages", *key)
            self.catalog.stages[key] = stage
            self.catalog.save()
            return stage

    def get(self, database: str, schema: str, name: str) -> Named:
        key = self._key(database, schema, name)
        if key not in self.catalog.stages:
            raise NotFound(f"stage {'.'.join(key)} does not exist")
        return self.catalog.stages[key]

    def list(self, database: str, schema: str) -> list[Named]:
        return sorted((s for k, s in self.catalog.stages.items() if k[:2] == (upper(database), upper(schema))), key=lambda s: s.name)

    def drop(self, database: str, schema: str, name: str, if_exists: bool = False) -> None:
        with self.catalog.lock:
            key = self._key(database, schema, name)
            if key not in self.catalog.stages:
                if if_exists:
                    return
                raise NotFound(f"stage {'.'.join(key)} does not exist")
            del self.catalog.stages[key]
            self.catalog.save()
            self.store.delete("stages", *key)

    def _internal(self, database: str, schema: str, name: str) -> tuple[str, ...]:
        if self.get(database, schema, name).more["stage_type"] != "INTERNAL":
            raise InvalidValue("files of external stages are out of reach")
        return ("stages", *self._key(database, schema, name))

    @staticmethod
    def _safe(name: str) -> list[str]:
        parts = name.split("/")
        if not name or name.startswith("/") or any(p in ("", ".", "..") for p in parts):
            raise InvalidValue(f"no file name for a stage: {name!r}")
        return parts

    def directory(self, database: str, schema: str, name: str) -> str:
        return self.store.url(*self._internal(database, schema, name))

    def put(self, database: str, schema: str, name: str, file: str, data: bytes) -> int:
        at = self._internal(database, schema, name)
        self.store.write(data, *at, *self._safe(file))
        return len(data)

    def read(self, database: str, schema: str, name: str, file: str) -> bytes:
        at = (*self._internal(database, schema, name), *self._safe(file))
        if not self.store.exists(*at):
            raise NotFound(f"no such file: {file}")
        return self.store.read(*at)

    def files(self, database: str, schema: str, name: str, pattern: str = "", below: str = "") -> list[tuple[str, int]]:
        """Names and sizes; ``pattern`` is a glob on the last part of the name, ``below`` a leading path."""
        at = self._internal(database, schema, name)
        below = below.strip("/")
        found = self.store.files(*at)
        return [(f, n) for f, n in found if (not pattern or fnmatchcase(f.rsplit("/", 1)[-1], pattern)) and (not below or f == below or f.startswith(below + "/") or f.startswith(below)) and not f.rsplit("/", 1)[-1].startswith(".")]

    def remove(self, database: str, schema: str, name: str, file: str) -> None:
        at = (*self._internal(database, schema, name), *self._safe(file))
        if not self.store.exists(*at):
            raise NotFound(f"no such file: {file}")
        self.store.delete(*at)
