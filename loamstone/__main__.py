"""Commands over a stored collection.

``python -m loamstone STORE search QUERY [TOP_K]``  the best chunks for a question
``python -m loamstone STORE ingest FOLDER``         everything in a folder that has a loader
``python -m loamstone STORE index``                 vectors and postings of all chunks anew
``python -m loamstone STORE backfill``              postings for chunks that lack them
``python -m loamstone STORE golden FILE``           a golden corpus (JSON) as one-chunk documents, indexed
``python -m loamstone STORE evaluate FILE [K]``     recall, precision and reciprocal rank of dense, sparse, hybrid
``python -m loamstone STORE health``                whether the store answers
"""

import sys

from .engine import Engine
from .operators import evaluation
from .operators.store import Store
from .session import build_session
from .sources.registry import read_folder, source_type


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    root, command, *rest = args
    engine = Engine(build_session(), Store(build_session(), root))
    if command == "search" and len(rest) in (1, 2):
        for r in engine.search(rest[0], int(rest[1]) if len(rest) == 2 else 5).orderBy("rank").collect():
            print(f"{r['rank']}. {r['score']:.6f} {r['document_id']}#{r['chunk_index']}\n{r['content'][:400]}\n")
    elif command == "ingest" and len(rest) == 1:
        files = read_folder(engine.spark, rest[0], engine.settings.upload_limit)
        engine.upload(files.filter(source_type(files["path"]).isNotNull()).select("path", "content"))
        print(engine.process())
    elif command == "index" and not rest:
        print(engine.index())
    elif command == "backfill" and not rest:
        print(engine.backfill())
    elif command == "golden" and len(rest) == 1:
        print(engine.add_golden(evaluation.golden(engine.spark, rest[0])[1]))
    elif command == "evaluate" and len(rest) in (1, 2):
        engine.evaluate(evaluation.golden(engine.spark, rest[0])[0], int(rest[1]) if len(rest) == 2 else 5).show(truncate=False)
    elif command == "health" and not rest:
        print(engine.health())
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
