import os
import pathlib

ROOT = str(pathlib.Path(__file__).resolve().parents[2])
# Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
os.environ.setdefault("OMP_NUM_THREADS", "1")
