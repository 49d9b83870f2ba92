"""Migration requests: dataclasses and their JSON. Unknown fields are ignored, errors are collected."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from .operators.transform import Transform, identity
from .settings import Settings


#: A request's JSON for tables of them; fields not named are ignored.
REQUEST_SCHEMA = (
    "source_index string, target_index string, alias string, transform_script struct<type:string,source:string,id:string,params:map<string,string>,script_context:string,apply_to_deletes:boolean>, "
    "options struct<target_shards:long,tolerance:long,validation_query:string,apply_to_deletes:boolean,data_loss_consent:boolean,convergence_threshold:long,max_convergence_rounds:long,target_ready_ms:long,transient_target_settings:map<string,string>,remove_write_block:boolean>"
)


class Rejected(ValueError):
    """A request that may not start."""


@dataclass
class Script:
    """A transform as text: `inline` with its source, or `stored` by id. See scripts.py."""

    type: str = "inline"
    source: str | None = None
    id: str | None = None
    params: dict = field(default_factory=dict)
    script_context: str = "update"
    apply_to_deletes: bool = False

    def errors(self) -> list[str]:
        if self.type not in ("inline", "stored"):
            return [f"script type {self.type!r} is neither inline nor stored"]
        if self.type == "inline" and not (self.source or "").strip():
            return ["an inline script needs a source"]
        if self.type == "stored" and not (self.id or "").strip():
            return ["a stored script needs an id"]
        return []


@dataclass
class Options:
    """What a request may set for itself; None falls back on the settings."""

    target_shards: int = 1
    tolerance: int = 0
    validation_query: dict | None = None
    apply_to_deletes: bool = False
    data_loss_consent: bool = False
    convergence_threshold: int | None = None
    max_convergence_rounds: int | None = None
    target_ready_ms: int | None = None
    transient_target_settings: dict[str, str] | None = None
    remove_write_block: bool | None = None

    def errors(self) -> list[str]:
        least = {"target_shards": 1, "tolerance": 0, "convergence_threshold": 0, "max_convergence_rounds": 0, "target_ready_ms": 1}
        return [f"{name} must be at least {n}" for name, n in least.items() if getattr(self, name) is not None and getattr(self, name) < n]

    def resolved(self, settings: Settings) -> Options:
        """These options over the settings."""
        given = {k: v for k, v in asdict(self).items() if v is not None}
        usual = {k: getattr(settings, k) for k in ("convergence_threshold", "max_convergence_rounds", "target_ready_ms", "remove_write_block")}
        return Options(**{"transient_target_settings": {"number_of_replicas": "0", "refresh_interval": "-1"}} | usual | given)


@dataclass
class Request:
    source: str
    target: str
    alias: str
    transform: Transform | Script = identity
    options: Options = field(default_factory=Options)

    def errors(self) -> list[str]:
        found = [f"{name} is missing" for name in ("source", "target", "alias") if not (getattr(self, name) or "").strip()]
        if self.source and self.source == self.target:
            found.append("source and target are the same")
        return found + (self.transform.errors() if isinstance(self.transform, Script) else []) + self.options.errors()

    def validate(self) -> None:
        if found := self.errors():
            raise Rejected("; ".join(found))

    @property
    def apply_to_deletes(self) -> bool:
        return self.options.apply_to_deletes or isinstance(self.transform, Script) and self.transform.apply_to_deletes

    @classmethod
    def decode(cls, text: str | dict) -> Request:
        """From JSON: source_index, target_index, alias, transform_script, options."""
        body = json.loads(text) if isinstance(text, str) else text
        script = body.get("transform_script")
        return cls(body.get("source_index") or "", body.get("target_index") or "", body.get("alias") or "", known(Script, script) if script else identity, known(Options, body.get("options") or {}))

    def encode(self) -> dict | None:
        """The JSON body; None if the transform is a function, which has no text."""
        if not isinstance(self.transform, Script) and self.transform is not identity:
            return None
        script = {"transform_script": asdict(self.transform)} if isinstance(self.transform, Script) else {}
        return {"source_index": self.source, "target_index": self.target, "alias": self.alias, "options": asdict(self.options)} | script


def known(kind, body: dict):
    """A dataclass from the fields of `body` that it has; nulls fall back on defaults."""
    names = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in body.items() if k in names and v is not None})
