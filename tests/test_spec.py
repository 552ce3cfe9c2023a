import pytest

from jobframe.operators.sinks import check_identifier
from jobframe.spec import ConditionStep, MapStep, PipelineSpec, SpecError


def test_default_dependency_is_previous_step():
    p = PipelineSpec(id="p", steps=(MapStep(id="a"), MapStep(id="b"), MapStep(id="c", depends_on=())))
    assert p.dependencies() == {"a": (), "b": ("a",), "c": ()}
    assert p.levels() == [["a", "c"], ["b"]]


def test_diamond_levels():
    p = PipelineSpec(id="p", steps=(MapStep(id="root"), MapStep(id="left", depends_on=("root",)),
                                    MapStep(id="right", depends_on=("root",)),
                                    MapStep(id="join", depends_on=("left", "right"))))
    assert p.levels() == [["root"], ["left", "right"], ["join"]]


def test_cycle_rejected():
    with pytest.raises(SpecError):
        PipelineSpec(id="p", steps=(MapStep(id="a", depends_on=("b",)), MapStep(id="b", depends_on=("a",))))


def test_bad_skip_target_and_map_target():
    with pytest.raises(SpecError):
        PipelineSpec(id="p", steps=(ConditionStep(id="c", action="skip_to", skip_to="nope"),))
    with pytest.raises(SpecError):
        PipelineSpec(id="p", steps=(MapStep(id="m", set=(("job.labels.x", "1"),)),))
    with pytest.raises(SpecError):
        PipelineSpec(id="p", steps=(MapStep(id="m", set=(("no_dot", "1"),)),))


def test_identifier_check():
    assert check_identifier("table", "results_1") == "results_1"
    for bad in ("1abc", "a-b", "a b", "", "a;drop"):
        with pytest.raises(ValueError):
            check_identifier("table", bad)
