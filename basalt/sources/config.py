"""Engine options from INI text, with environment overrides and typed values."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, field


def typed(value: str):
    """A number if it reads as one, with a point a float; else the text."""
    try:
        return float(value) if "." in value else int(value)
    except ValueError:
        return value


@dataclass
class Options:
    sections: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Options:
        parser = configparser.ConfigParser()
        parser.read_string(text)
        return cls({s: {k: typed(v) for k, v in parser[s].items()} for s in parser.sections()})

    def provider(self, profile: str, environment: dict[str, str] | None = None) -> dict:
        """A profile's endpoint; API_KEY, BASE_URL and MODEL of the environment win. A profile that is missing is an error."""
        env = os.environ if environment is None else environment
        if profile not in self.sections:
            raise KeyError(f"no profile {profile!r}; there are {sorted(self.sections)}")
        return self.sections[profile] | {k: env[e] for k, e in (("api_key", "API_KEY"), ("base_url", "BASE_URL"), ("model", "MODEL")) if e in env}

    def generation(self, stage: str) -> dict:
        return self.sections.get(f"generation_{stage}", {})
