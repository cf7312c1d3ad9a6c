"""All queries of the library, by area."""

from . import lexicon, quality, search, sources, topics, user

AREAS = [search.roster, lexicon.roster, topics.roster, quality.roster, user.roster, sources.roster]
