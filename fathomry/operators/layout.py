"""What a well is for: roles as layouts write them, and as sample names tell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How layouts write roles, without case, spaces, dots, hyphens and underscores.
ROLES = {
    "blank": ["blank", "blk", "bl", "blanks", "buffer", "bufferonly", "background", "bg", "bkg", "bkgd", "reagentblank", "nocell", "nocells", "cellfree", "mediumonly", "mediaonly"],
    "standard": ["standard", "std", "standards", "stds", "calibrator", "calibrators", "cal", "calib", "stdcurve", "standardcurve", "s"],
    "sample": ["sample", "samples", "spl", "unknown", "unk", "un", "u", "test", "x", "smp", "compound", "treatment", "dose"],
    "positive": ["positive", "pos", "positivecontrol", "pc", "posctrl", "poscontrol", "posctl", "poscon", "positivectrl", "pctrl", "highcontrol", "hc", "max", "maximum", "maxsignal", "highsignal", "high", "+"],
    "negative": ["negative", "neg", "negativecontrol", "nc", "negctrl", "negcontrol", "negctl", "negcon", "negativectrl", "nctrl", "lowcontrol", "lc", "min", "minimum", "minsignal", "lowsignal", "low", "-"],
    "control": ["control", "ctrl", "ctl", "qc", "controls", "vehicle", "vehiclecontrol", "dmso", "dmsocontrol", "solvent", "solventcontrol", "untreated"],
    "empty": ["empty", "none", "unused", "na", "n/a", ""],
}
#: What names of a role begin with, and what stands before nothing but digits and colons.
NAMES = {
    "blank": (["blank", "buffer", "nocell", "background", "mediumonly"], ["blk", "bl"]),
    "standard": (["standard", "calibrator"], ["std", "cal"]),
    "positive": (["positive", "poscontrol"], ["pos", "pc", "poscon", "posctrl", "posctl"]),
    "negative": (["negative", "negcontrol"], ["neg", "nc", "negcon", "negctrl", "negctl"]),
    "control": (["control", "vehicle", "dmso", "untreated"], ["ctl", "ctrl"]),
}


def _plain(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.isin("-", "+"), t).otherwise(F.lower(F.regexp_replace(t, "[ _.-]", "")))


def role(c: Column) -> Column:
    """The role that a layout's cell names, else null."""
    return F.coalesce(*(F.when(_plain(c).isin(words), F.lit(name)) for name, words in ROLES.items()))


def role_of_name(c: Column) -> Column:
    """The role that a sample's name tells; a name that tells none is a sample's, none at all an empty well's."""
    t = _plain(F.coalesce(c, F.lit("")))
    found = [F.when(t.rlike(f"^(?:{'|'.join(begin)})|^(?:{'|'.join(counted)})[0-9:]*$"), F.lit(name)) for name, (begin, counted) in NAMES.items()]
    return F.coalesce(*found, F.when(t.rlike("^s[0-9:]+$"), F.lit("standard")), F.when(t.isin("", "empty", "unused", "none", "na", "-"), F.lit("empty")), F.lit("sample"))
