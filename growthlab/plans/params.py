"""Fixed parameters of the query catalogue."""

import datetime as _dt

D = _dt.date

# calibration / hold-out windows on the sales view
CAL_START = D(1995, 1, 1)
CAL_END = D(1999, 12, 31)
HOLD_START = D(2000, 1, 1)
HOLD_END = D(2001, 8, 1)
CATEGORY = "Brand#1"
# RFM window: all of 2000
RFM_START = D(2000, 1, 1)
RFM_END = D(2000, 12, 31)

# banner / score days
SCORE_DAY = D(2024, 1, 20)
SALES_START = D(2024, 1, 21)
SALES_END = D(2024, 1, 30)
ROLL_FIRST = D(2024, 1, 20)
ROLL_LAST = D(2024, 1, 26)

TOP_K = 6
TOP_N = 10

# fixed model parameters (published CDNOW estimates, alpha in days)
BG_R, BG_ALPHA, BG_A, BG_B = 0.243, 30.9, 0.793, 2.426
GG_P, GG_Q, GG_V = 6.25, 3.74, 15.44
HOLDOUT_T = 578          # days from 2000-01-01 to 2001-08-01
CLV_MONTHS = 6
CLV_DISCOUNT = 0.1
CLV_FREQ = "D"
CLV_ADJ_FLOOR = 0.02
