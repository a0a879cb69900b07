"""The modules of this subpackage whose queries the driver runs."""

from mergekin.llm import p1_groups, p2_works, p3_names, p4_terms, p5_survivors, p6_packing, p7_mixing, p8_reading

MODULES = [p1_groups, p2_works, p3_names, p4_terms, p5_survivors, p6_packing, p7_mixing, p8_reading]
