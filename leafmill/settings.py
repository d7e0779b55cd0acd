"""Settings from a file of KEY=VALUE lines and the environment, which wins.

What there is to set is a table: each row says a setting's name, how its text is read, what it is without one, and under
which name it is known here.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace
from typing import NamedTuple

from .providers import Factory, ProviderError

#: What the settings' names begin with; another prefix can be named in the environment.
PREFIX = os.environ.get("LEAFMILL_PREFIX", "LEAFMILL_")
PROJECT = Path(__file__).resolve().parents[1]

#: Where a key is looked for besides API_KEY. Fixed values.
KEYS = {"openai": "OPENAI_API_KEY", "google": "GEMINI_API_KEY"}


class SettingsError(ValueError):
    pass


def _provider(text: str) -> str:
    name = text.strip().lower()
    if name not in Factory.KINDS:
        raise ValueError(f"one of {', '.join(Factory.KINDS)}")
    return name


def _options(text: str) -> dict:
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a JSON object")
    return value


def _switch(text: str) -> bool:
    return text.strip().lower() not in {"0", "false", "no", "off"}


def _names(text: str) -> frozenset:
    return frozenset(re.findall(r"[^,\s](?:[^,]*[^,\s])?", text))


class Setting(NamedTuple):
    name: str
    known_as: str
    read: Callable
    without: object = None
    needed: bool = False


SETTINGS = (
    Setting("PROVIDER", "type", _provider, needed=True),
    Setting("MODEL", "model", str, needed=True),
    Setting("API_KEY", "api_key", str),
    Setting("BASE_URL", "base_url", str),
    Setting("JSON_MODE", "json_mode", _switch, True),
    Setting("MAX_OUTPUT_TOKENS", "max_output_tokens", int),
    Setting("TEMPERATURE", "temperature", float),
    Setting("TIMEOUT", "timeout", float),
    Setting("EXTRA", "extra", _options, {}),
    Setting("DROP_CLASS", "drop_classes", _names, frozenset()),
    Setting("DROP_DOC", "drop_docs", _names, frozenset()),
)

#: Which settings a provider takes besides the model.
TAKES = {"marking": (), "claude": ("timeout", "extra"), "openai": (services := ("api_key", "base_url", "json_mode", "max_output_tokens", "temperature", "timeout", "extra")), "google": services}

#: A line of a settings file: a name, and a value in quotes or up to a comment.
_LINE = re.compile(r"""^[ \t]*(?:export[ ]+)?([^\s=#][^=\n]*?)[ \t]*=[ \t]*(?:"([^"\n]*)"|'([^'\n]*)'|(.*?))[ \t]*(?:[ \t]#.*)?$""", re.M)


def parse_env(text: str) -> dict[str, str]:
    """Blank lines, comments and lines without a name are passed over; `export` and quotes are optional; ` #` ends a value without quotes."""
    return {m[1]: next((x for x in m.groups()[1:] if x is not None), "") for m in _LINE.finditer(text)}


def find_env(path: str | Path | None = None) -> Path | None:
    """The file named, which must be there; else `.env` here, else in the project."""
    places = [Path(path)] if path is not None else [Path.cwd() / ".env", PROJECT / ".env"]
    there = [p for p in places if p.is_file()]
    if path is not None and not there:
        raise SettingsError(f"there is no settings file {path}")
    return there[0] if there else None


def _file(source: Path | None) -> dict[str, str]:
    if source is None:
        return {}
    try:
        return parse_env(source.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        raise SettingsError(f"{source} can't be read: {e}") from None


def load(path: str | Path | None = None, provider: str | None = None, model: str | None = None) -> SimpleNamespace:
    """Every setting of the table by the name that it is known as, and `source`, the file. provider and model outrank both."""
    source = find_env(path)
    texts = _file(source) | {k: v for k, v in os.environ.items() if v} | {PREFIX + k: v for k, v in (("PROVIDER", provider), ("MODEL", model)) if v}
    out = SimpleNamespace(source=source)
    for s in SETTINGS:
        text = texts.get(PREFIX + s.name)
        if not text and s.needed:
            raise SettingsError(f"{PREFIX}{s.name} isn't set; it may stand in {source or PROJECT / '.env'}")
        try:
            setattr(out, s.known_as, s.read(text) if text else s.without)
        except ValueError as e:
            raise SettingsError(f"{PREFIX}{s.name} can't be {text!r}: {e}") from None
    out.api_key = out.api_key or texts.get(KEYS.get(out.type))
    return out


def factory(settings: SimpleNamespace) -> Factory:
    """The provider's factory; settings that can't work are an error here, not on an executor."""
    takes = TAKES[settings.type]
    if "api_key" in takes and not settings.api_key:
        raise SettingsError(f"no key: set {PREFIX}API_KEY or {KEYS[settings.type]}")
    made = Factory(settings.type, model=settings.model, **{name: getattr(settings, name) for name in takes})
    try:
        made()
    except ProviderError as e:
        raise SettingsError(str(e)) from None
    return made
