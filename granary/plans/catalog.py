"""Every query of the library, and the SQL that its result equals where SQL can say it."""

from . import answers, corpus, reports, structure, understanding

QUERIES = reports.QUERIES | understanding.QUERIES | corpus.QUERIES | structure.QUERIES | answers.QUERIES
ORACLES = reports.ORACLES | understanding.ORACLES | corpus.ORACLES | structure.ORACLES | answers.ORACLES
