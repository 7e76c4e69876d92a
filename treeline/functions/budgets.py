"""Token budgets of prompts, by the context of the server that answers them. Driver-side arithmetic."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# What a server is taken to have unless told otherwise, in tokens.
CONTEXT, OUTPUT, MARGIN = 16384, 2048, 256
# What prompts hold besides their payload; bounds of budgets; the budget where context is ample.
GROUP_PROMPT, SUMMARY_PROMPT, CHAT_FRAME = 1600, 80, 256
LEAST_GROUP, MOST_GROUP, LEAST_SUMMARY, LEAST_ANSWER = 2000, 10000, 1024, 256
AMPLE_GROUP = 20000


@dataclass(frozen=True)
class Server:
    """limited: the context is one's own server's and must be minded; hosted services have ample."""

    limited: bool
    context: int = CONTEXT
    output: int = OUTPUT
    margin: int = MARGIN

    @classmethod
    def of(cls, model: str | None, settings: Mapping[str, int] | None = None) -> Server:
        """By the model's route; settings may give context, output and margin."""
        route = (model or "").removeprefix("litellm/").partition("/")
        return cls(bool(route[1]) and route[0] in ("vllm", "hosted_vllm"), **(settings or {}))

    def group_tokens(self) -> int:
        """Pages that go into one prompt together."""
        if not self.limited:
            return AMPLE_GROUP
        left = self.context - self._answer() - self.margin - GROUP_PROMPT
        return max(LEAST_GROUP, min(left, self.context // 2, MOST_GROUP))

    def summary_tokens(self) -> int | None:
        """Text of a node to be summarised in one prompt; None: as much as there is."""
        if not self.limited:
            return None
        return max(LEAST_SUMMARY, self.context - (self.output or OUTPUT) - self.margin - CHAT_FRAME - SUMMARY_PROMPT)

    def answer_tokens(self, prompt_tokens: int) -> int | None:
        """Most tokens to ask for; None: the server's own limit. A prompt that leaves no room is an error."""
        if not self.limited or self.output <= 0:
            return None
        room = self.context - prompt_tokens - self.margin
        if room < LEAST_ANSWER:
            raise ValueError(f"a prompt of {prompt_tokens} tokens leaves {room} of {self.context}")
        return min(self.output, room)

    def _answer(self) -> int:
        return self.output if self.output > 0 else OUTPUT
