"""Settings of the document pipeline: four sections, JSON, dotted keys; absent keys take their default."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass
class Ocr:
    enable_detection: bool = True
    enable_classification: bool = True
    enable_recognition: bool = True
    detection_threshold: float = 0.3
    recognition_threshold: float = 0.0
    max_image_size: int = 960
    keep_unk: bool = False


@dataclass
class Pdf:
    prefer_embedded_text: bool = True
    min_text_length: int = 50


@dataclass
class Extraction:
    validate_nip: bool = True
    validate_regon: bool = True
    validate_iban: bool = True
    default_currency: str = "PLN"


@dataclass
class Models:
    folder: str = "models"
    variant: str = "mobile"


@dataclass
class Config:
    ocr: Ocr = field(default_factory=Ocr)
    pdf: Pdf = field(default_factory=Pdf)
    extraction: Extraction = field(default_factory=Extraction)
    models: Models = field(default_factory=Models)

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        out = cls()
        for section in fields(cls):
            part = getattr(out, section.name)
            for key, value in data.get(section.name, {}).items():
                if hasattr(part, key):
                    setattr(part, key, value)
        return out

    @classmethod
    def load(cls, path: str) -> Config:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def text(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def save(self, path: str) -> None:
        Path(path).write_text(self.text())

    def get(self, key: str) -> Any:
        value: Any = asdict(self)
        for part in key.split("."):
            value = value[part]
        return value

    def set(self, key: str, value: str) -> None:
        """Sets a dotted key; the value is JSON where it can be read as such, else text."""
        section, name = key.split(".")
        part = getattr(self, section)
        if not hasattr(part, name):
            raise KeyError(key)
        try:
            parsed = json.loads(value)
        except json.JSONDecodeError:
            parsed = value
        setattr(part, name, parsed)
