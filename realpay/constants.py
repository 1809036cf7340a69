"""Fixed values of the analysed report, stated once in the report's order.

These must equal the report's values for the results to be the same; every
module imports them from here.
"""

# Data-quality section.
IQR_MULTIPLIER = 1.5                                  # fences at Q1 - 1.5 IQR, Q3 + 1.5 IQR
CORR_COLUMNS = ("salary_usd", "years_experience", "benefits_score", "remote_ratio")

# SQL section.
SKILL_SEPARATOR = ","
TOP_K = 10                                            # top skills, top locations, top countries

# Cost-of-living dimension and the merged column names.
COST_INDEX = "Cost of Living Index"
PLUS_RENT_INDEX = "Cost of Living Plus Rent Index"
LPP_INDEX = "Local Purchasing Power Index"
MERGED_COLUMNS = {"col_index": COST_INDEX, "col_plus_rent": PLUS_RENT_INDEX, "lpp": LPP_INDEX}
SAMPLE_ROWS = 6                                       # rows shown of the merged table

# PPP rule.
INDEX_WEIGHT = 0.5                                    # weight of the cost index (rest: plus-rent index)
INDEX_BOUNDS = (40.0, 150.0)                          # weighted cost index clamp
LPP_BOUNDS = (30.0, 80.0)                             # local purchasing power clamp
MIN_SALARY = 2000.0                                   # no PPP salary below this
MIN_JOBS = 10                                         # countries need this many postings
