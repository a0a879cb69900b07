"""The modules whose queries the driver runs."""

from mergekin.plans import basics, bibliography, linkage, records, reports, truths

MODULES = [linkage, bibliography, basics, records, reports, truths]
