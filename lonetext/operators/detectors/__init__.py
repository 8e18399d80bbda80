"""Anomaly detectors. `fit(train)` returns the detector, `score(rows)` adds `score`, higher = more anomalous."""

from .base import Detector
from .boosted import XGBOD
from .deep import AutoEncoder, DeepSAD, DeepSVDD, DevNet, VariationalAutoEncoder
from .density import KDE
from .forest import IsolationForest
from .histogram import HBOS
from .local_outlier import LOF
from .oneclass import OCSVM
from .perceptron import MLP
from .principal import PCADetector

__all__ = ["Detector", "IsolationForest", "LOF", "HBOS", "OCSVM", "KDE", "PCADetector", "AutoEncoder",
           "VariationalAutoEncoder", "DeepSVDD", "DeepSAD", "DevNet", "XGBOD", "MLP"]
