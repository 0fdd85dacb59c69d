"""Queries over citation markers of all families. Tests compare them with a pass over each paper."""

from __future__ import annotations

from .operators import intext
from .registry import over

_OF = ("v_section", "v_paper_ref")
over("tokenised_papers", _OF, lambda s, r: intext.tokenised(s, r)[0])
over("unlinked_markers", _OF, lambda s, r: intext.tokenised(s, r)[1])
over("citation_styles", _OF, intext.styles_of)
over("token_contexts", ("v_state",), intext.contexts)
