"""What people edit, read into what the operators take: terms of the gate, the lexicon of themes, the overlay of policies, phrases, settings.

These are small files of the driver's. A missing file is the empty policy, but for phrases, without which nothing can be composed.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from quillspan.operators.gate import Category, Theme
from quillspan.operators.suggest import Bank, Guide
from quillspan.sources.files import read_policy


@dataclass(frozen=True)
class Gate:
    """categories in order; notice: what a request in a crisis is told; narrow_to: labels of the records that it may see; approved: whether the wording was signed off."""

    categories: list[Category] = field(default_factory=list)
    notice: str = ""
    narrow_to: tuple[str, ...] = ()
    approved: bool = False


@dataclass(frozen=True)
class Lexicon:
    themes: list[Theme] = field(default_factory=list)
    markers: list[str] = field(default_factory=list)
    stopwords: tuple[str, ...] = ()


def _strings(values: object, where: str) -> list[str]:
    """A list of strings; anything else in it (an unquoted yes or no) is an error that names the place."""
    wrong = [v for v in values or [] if not isinstance(v, str)]
    if wrong:
        raise ValueError(f"{where}: {wrong!r} are not strings; quote them")
    return list(values or [])


def _read(path: str) -> dict:
    return read_policy(path) if Path(path).exists() else {}


def load_gate(path: str) -> Gate:
    """categories (name, terms, patterns), notice, allowed_contents, sign_off ('pending': not yet)."""
    doc = _read(path)
    made = [Category(c["name"], _strings(c.get("terms"), f"{c['name']}.terms"), [f"(?i){p}" for p in _strings(c.get("patterns"), f"{c['name']}.patterns")]) for c in doc.get("categories") or []]
    return Gate(made, str(doc.get("notice") or "").strip(), tuple(_strings(doc.get("allowed_contents"), "allowed_contents")), str(doc.get("sign_off", "pending")) != "pending")


def load_lexicon(path: str) -> Lexicon:
    """themes (name, terms, contents, contexts, expansions), intercessory_markers, stopwords."""
    doc = _read(path)

    def listed(theme: dict, key: str) -> list[str]:
        return _strings(theme.get(key), f"theme {theme.get('name')}.{key}")

    themes = [Theme(t["name"], listed(t, "terms"), listed(t, "contents"), listed(t, "contexts"), listed(t, "expansions")) for t in doc.get("themes") or []]
    return Lexicon(themes, [m.lower() for m in _strings(doc.get("intercessory_markers"), "intercessory_markers")], tuple(_strings(doc.get("stopwords"), "stopwords")))


def load_overlay(spark: SparkSession, path: str, key: str = "prayers") -> DataFrame:
    """(id, policy, reason, seq) for with_policy: an entry is a policy, or has policy (compose, if it isn't given) and reason. Ids that no record has change nothing."""
    rows = []
    for seq, (name, entry) in enumerate((_read(path).get(key) or {}).items()):
        given = {"policy": entry} if isinstance(entry, str) else entry or {}
        rows.append((str(name), given.get("policy", "compose"), given.get("reason"), seq))
    return spark.createDataFrame(rows, "id string, policy string, reason string, seq long")


def load_phrases(path: str, stern_labels: frozenset[str] = frozenset(), vocatives: tuple[str, ...] = ()) -> tuple[Bank, Guide, str]:
    """The phrases to compose from, those of the instructions, and the note of records that are only explained.

    Options stay in the order of the file, as picks go by their place.
    """
    doc = read_policy(path)

    def options(*keys: str) -> tuple[str, ...]:
        at: object = doc
        for k in keys:
            at = (at or {}).get(k)
        return tuple(_strings(at, ".".join(keys)))

    def by_label(section: str) -> dict[str, tuple[str, ...]]:
        return {str(k): tuple(_strings(v, f"{section}.by_content.{k}")) for k, v in ((doc.get(section) or {}).get("by_content") or {}).items()}

    bank = Bank(
        address=options("address", "fallback"), naming=options("naming", "first_person"), naming_for_others=options("naming", "intercessory"), ask=options("ask", "default"), trust=options("trust", "default"),
        close=options("close", "default"), extensions=options("ask", "extensions"), ask_by_label=by_label("ask"), trust_by_label=by_label("trust"), stern_labels=stern_labels, stern_ask=options("ask", "imprecatory"), vocatives=vocatives,
    )
    told = doc.get("instructions") or {}
    why, how = told.get("why_it_fits") or {}, told.get("how_to_pray") or {}
    speaker = {str(k).lower(): v for k, v in (why.get("speaker_by_collective") or {}).items()}
    base = Guide()
    guide = Guide(
        template=why.get("template", base.template), speaker=speaker.get("false", base.speaker), speaker_collective=speaker.get("true", base.speaker_collective), contents=why.get("contents_clause", base.contents),
        themes=why.get("themes_clause", base.themes), no_themes=why.get("themes_clause_empty", base.no_themes), gloss_by_context=dict(told.get("context_gloss") or {}), how_by_context=dict(how.get("by_context") or {}),
        posture_by_context=dict(told.get("posture") or {}), specifics=how.get("specifics_note", ""), single_verse=how.get("single_verse_note", ""), long_passage=how.get("long_passage_note", ""), stern=how.get("imprecatory_note", ""),
    )
    return bank, guide, str(doc.get("explain_only_note") or "").strip()


@dataclass(frozen=True)
class Settings:
    """What a run may set; each can come from a file (its sections don't matter) and be overridden by a variable of the environment."""

    retriever: str = "bm25"
    composer: str = "deterministic"
    k: int = 3
    abstain_threshold: float = 0.08
    psalm_penalty: float = 0.0
    candidate_pool: int = 25
    max_passage_verses_inline: int = 20
    excerpt_verses: int = 8
    include_copyrighted_text: bool = False


def load_settings(path: str | None, prefix: str, environ: Mapping[str, str] | None = None) -> Settings:
    """Environment over file over default. Names that Settings lacks are passed over; a value of the wrong type is an error that names the setting."""
    doc = (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}) if path and Path(path).exists() else {}
    flat: dict[str, object] = {}
    for section, value in doc.items():
        flat |= value if isinstance(value, dict) else {section: value}
    environ = os.environ if environ is None else environ
    flat |= {f.name: environ[prefix + f.name.upper()] for f in fields(Settings) if prefix + f.name.upper() in environ}

    def cast(name: str, kind: type, value: object) -> object:
        try:
            if kind is bool:
                return value if isinstance(value, bool) else {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}[str(value).strip().lower()]
            return kind(value)
        except (KeyError, TypeError, ValueError):
            raise ValueError(f"{name}: {value!r} is no {kind.__name__}") from None

    return Settings(**{f.name: cast(f.name, type(f.default), flat[f.name]) for f in fields(Settings) if flat.get(f.name) is not None})
