from risklib.functions.exprs import (cut, cyclic_distance, flag, micros, period_of_day_a,
                                     period_of_day_b, r6, safe_div, weekday)

__all__ = ["cut", "cyclic_distance", "flag", "micros", "period_of_day_a", "period_of_day_b",
           "r6", "safe_div", "weekday"]
