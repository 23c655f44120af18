"""Deterministic stand-in predictors for tests and the registered inference query.

They implement the predictor protocol of :mod:`scorebook.operators.inference`
(``load``, ``unload``, ``predict(content, prompt) -> dict``) without any model.
"""

from __future__ import annotations


class EchoPredictor:
    """Answers ``DIAGNOSIS: <content text>``; content ``boom`` raises (error path)."""

    def __init__(self, name=None):
        self.name = name

    def load(self) -> None:
        pass

    def unload(self) -> None:
        pass

    def predict(self, content, prompt):
        text = bytes(content).decode() if content is not None else ""
        if text == "boom":
            raise RuntimeError("model failed")
        return {"raw_output": f"DIAGNOSIS: {text}", "input_tokens": len(text),
                "output_tokens": 2, "cost_usd": 0.001 if self.name == "api" else 0.0}


class KeywordPredictor:
    """Answers from the text it is shown: the first class word found, else a
    CoT-style guess chosen by text length."""

    words = ("atrial", "ventricular", "ductus", "normal")

    def __init__(self, name=None):
        self.name = name

    def load(self) -> None:
        pass

    def unload(self) -> None:
        pass

    def predict(self, content, prompt):
        text = (bytes(content).decode("utf-8", "replace") if content is not None else "").lower()
        hits = [w for w in self.words if w in text]
        answer = f"DIAGNOSIS: {['ASD', 'VSD', 'PDA', 'Normal'][len(text) % 4]}" if not hits \
            else f"Findings: {hits[0]} pattern."
        return {"raw_output": answer, "input_tokens": len(text) // 4 + len(prompt) // 4,
                "output_tokens": len(answer) // 4, "cost_usd": 0.0, "latency_s": 0.0}


class FaultyPredictor(EchoPredictor):
    """Fails by the length of the content: of length 0 mod 5 for good, 1 mod 5 always for a while,
    2 mod 5 at the first attempt; else it answers with the length."""

    def __init__(self, name=None):
        super().__init__(name)
        self.tried = set()

    def predict(self, content, prompt):
        n = len(bytes(content))
        if n % 5 == 0:
            raise ValueError("not a picture")
        key = (bytes(content), prompt)
        if n % 5 == 1 or (n % 5 == 2 and key not in self.tried):
            self.tried.add(key)
            raise TimeoutError("busy")
        self.tried.discard(key)
        return {"raw_output": f"{n} bytes", "input_tokens": n}


class KeywordBatchPredictor(KeywordPredictor):
    """The same answers, several rows a call; it has no call for a single row."""

    predict = property()        # hasattr() says no

    def predict_batch(self, contents, prompts):
        return [KeywordPredictor.predict(self, c, p) for c, p in zip(contents, prompts)]


from scorebook._ship import ship  # noqa: E402

ship(__name__)
