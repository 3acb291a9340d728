"""daypanel: a Spark toolkit for security-by-day panels.

Raw all-text files become a typed table, a flagged table, a point-in-time
tradable universe, forward-return labels and a date-normalised model panel.
Every operator is a function from DataFrame to DataFrame.
"""

from daypanel.schema import DAILY_STOCK, PanelKey, PanelSchema

__all__ = ["DAILY_STOCK", "PanelKey", "PanelSchema"]
