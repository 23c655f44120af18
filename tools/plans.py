"""Print the formatted physical plan of registered queries (for plan review).

    python tools/plans.py [sf_dir] [key ...]
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scorebook.plans import registry  # noqa: E402
from scorebook.session import local_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    keys = sys.argv[2:] or ["metrics", "mcnemar", "calibration", "parse_labels"]
    spark = local_session(4)
    for k in keys:
        print(f"===== {k} =====")
        registry.QUERIES[k](spark, sf).explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
