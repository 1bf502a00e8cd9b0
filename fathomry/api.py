"""The public calls: read, batch, summarize, link, search, health, analyze, save."""

from .operators.health import at_risk, exact_duplicates, near_duplicates, pii_tally, tallies
from .operators.joins import layout_join, sheet_join
from .operators.link import groups as link_groups
from .operators.link import link
from .operators.search import search
from .operators.summarize import summarize
from .plans.batch import Batch as batch
from .plans.batch import analyze
from .sources.formats import register
from .sources.tables import crawl, read_sheet, read_table, save_table

__all__ = ["analyze", "at_risk", "batch", "crawl", "exact_duplicates", "layout_join", "link", "link_groups", "near_duplicates", "pii_tally", "read_sheet", "read_table", "register", "save_table", "search", "sheet_join", "summarize", "tallies"]
