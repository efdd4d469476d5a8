from kinsplit.functions.kernels import TanimotoBit, TanimotoReal

__all__ = ["TanimotoBit", "TanimotoReal"]
