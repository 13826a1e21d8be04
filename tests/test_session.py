import os
import subprocess
import sys

import pytest

from pointfield.plans import session


def there(df):
    return os.path.isdir(df._scratch_path.removeprefix("file:").replace("///", "/"))


def test_passing_deletes_what_is_not_kept(spark):
    df = spark.range(3)
    with session.passing(spark) as outer:
        with session.passing(spark) as keep:
            a, b, c = (session.materialize(df, "t") for _ in range(3))
            keep(a, b)
        assert there(a) and there(b) and not there(c)
        outer(a)
    assert there(a) and not there(b) and a.count() == 3
    session.drop(a, df)
    assert not there(a)


def test_passing_deletes_all_after_a_failure(spark):
    with pytest.raises(ValueError), session.passing(spark) as keep:
        a = keep(session.materialize(spark.range(3), "t"))
        raise ValueError
    assert not there(a)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "pointfield.llm", "xxhash_is_absent"])
def test_entry_forgives_the_absent_subpackage_alone(gone):
    """A module that cannot be found, as the finder would say it."""
    code = f"""
import sys
class No:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or ({gone!r} == 'xxhash_is_absent' and name == 'corpus_pipeline'):
            raise ModuleNotFoundError(name, name='xxhash' if {gone!r} == 'xxhash_is_absent' else name)
sys.meta_path.insert(0, No())
import __spark_entry__ as e
assert e.queries() and not any(k.startswith('op') for k in e.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=120)
    assert (done.returncode == 0) == (gone != "xxhash_is_absent"), done.stderr
