"""Named queries over the tables of a folder."""

from vellora.plans.blocks import Q as blocks
from vellora.plans.documents import Q as documents
from vellora.plans.findings import Q as findings
from vellora.plans.integrity import Q as integrity
from vellora.plans.matching import Q as matching
from vellora.plans.texts import Q as texts

ALL = [integrity, texts, blocks, documents, findings, matching]
