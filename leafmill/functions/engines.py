"""Recognition engines by name, each found only where its library is installed; the contract is (text, confidence) of a picture.

An engine is made once a worker.  Confidence is the mean over the words kept, from least on; 0.5 where there are none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from leafmill.functions import hooks, imaging

#: Engines by the names that settings use.
NAMES = {"tesseract": "pytesseract", "easyocr": "easyocr", "paddle": "paddleocr", "paddleocr": "paddleocr", "surya": "surya"}
# Fixed value: the confidence of an engine that gives none.
FLAT = 0.85


def joined(words: list[tuple[str, float]], least: float = 0.6, by: str = " ") -> tuple[str, float]:
    """(text, mean confidence) of the words that are sure enough and not blank."""
    kept = [(w, c) for w, c in words if c >= least and w.strip()]
    return by.join(w for w, _ in kept), sum(c for _, c in kept) / len(kept) if kept else 0.5


def _tesseract(img: np.ndarray) -> tuple[str, float]:
    lib = hooks.library("pytesseract")
    data = lib.image_to_data(img, config="--oem 3 --psm 6", output_type=lib.Output.DICT)
    # percentages; below 0 is no word
    return joined([(w, float(c) / 100) for w, c in zip(data["text"], data["conf"]) if float(c) >= 0])


def _easyocr(img: np.ndarray) -> tuple[str, float]:
    reader = hooks.once("easyocr reader", lambda: hooks.library("easyocr").Reader(["en"]))
    return joined([(t, float(c)) for _, t, c in reader.readtext(img)], by="\n")


def _paddle(img: np.ndarray) -> tuple[str, float]:
    reader = hooks.once("paddle reader", lambda: hooks.library("paddleocr").PaddleOCR(use_angle_cls=True, lang="en"))
    return joined([(t, float(c)) for _, (t, c) in (reader.ocr(img) or [[]])[0] or []], by="\n")


def _surya(img: np.ndarray) -> tuple[str, float]:
    predict = hooks.once("surya", lambda: hooks.library("surya").recognition.RecognitionPredictor())
    lines = predict([img])[0].text_lines
    return "\n".join(x.text for x in lines), FLAT


_RUN = {"pytesseract": _tesseract, "easyocr": _easyocr, "paddleocr": _paddle, "surya": _surya}


def find(name: str) -> Callable[[bytes], tuple[str, float]] | None:
    """The engine of a name; None for an unknown name and where its library is missing."""
    module = NAMES.get(name)
    if module is None or hooks.library(module) is None:
        return None

    def run(data: bytes) -> tuple[str, float]:
        img = imaging.decode(data)
        return _RUN[module](img) if img is not None else ("", 0.0)

    return run
